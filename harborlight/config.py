"""Settings of a deployment: read from a mapping, all faults reported at once."""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

MAX_SUBNETS, MAX_LABEL_CHARS = 2_000, 100
# Names, and what holds where one is not set.
DEFAULTS = {"CVE_TTL_HOURS": "24", "KEV_TTL_HOURS": "6", "EPSS_TTL_HOURS": "24", "FEED_MAX_RETRIES": "3"}
PREFIX = "HARBORLIGHT_"


class SettingsError(ValueError):
    """Every fault of a configuration, one per line."""


@dataclass(frozen=True)
class Settings:
    tenant_id: int
    warehouse: str
    cve_ttl_hours: int
    kev_ttl_hours: int
    epss_ttl_hours: int
    feed_max_retries: int
    subnets: dict[str, str] = field(default_factory=dict)


def load_settings(env: Mapping[str, str]) -> Settings:
    faults: list[str] = []
    get = lambda k: (env.get(PREFIX + k) or "").strip() or DEFAULTS.get(k, "")

    def whole(key: str, least: int) -> int:
        try:
            n = int(get(key))
        except ValueError:
            faults.append(f"{PREFIX}{key} must be a whole number; got {get(key)!r}")
            return least
        if n < least:
            faults.append(f"{PREFIX}{key} must be at least {least}; got {n}")
        return n

    subnets: dict[str, str] = {}
    try:
        raw = json.loads(get("SUBNETS") or "{}")
        if not isinstance(raw, dict) or len(raw) > MAX_SUBNETS:
            raise ValueError
        for cidr, label in raw.items():
            text = " ".join(str(label).split())
            try:
                subnets[str(ipaddress.ip_network(cidr.strip(), strict=True))] = text
            except ValueError as e:
                faults.append(f"{PREFIX}SUBNETS: {cidr!r} is not a network: {e}")
            if not 0 < len(text) <= MAX_LABEL_CHARS:
                faults.append(f"{PREFIX}SUBNETS: the label of {cidr!r} is empty or too long")
    except ValueError:
        faults.append(f"{PREFIX}SUBNETS must be a JSON object of at most {MAX_SUBNETS} networks")
    if not get("WAREHOUSE"):
        faults.append(f"{PREFIX}WAREHOUSE must be set")
    numbers = {k: whole(k, 1) for k in DEFAULTS}
    tenant = whole("TENANT_ID", 0)
    if faults:
        raise SettingsError("\n".join(faults))
    return Settings(tenant, get("WAREHOUSE"), numbers["CVE_TTL_HOURS"], numbers["KEV_TTL_HOURS"], numbers["EPSS_TTL_HOURS"], numbers["FEED_MAX_RETRIES"], subnets)
