"""Priority bands: one table of rules, read top to bottom; the first row whose conditions all hold gives band, rule and reason.

A row may ask for confidence states, for the known-exploited flag, and for a least score; an empty condition holds always and
a missing score reaches no least one. Reasons are templates; the table is compiled into one expression.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalized, percent


class Row(NamedTuple):
    rule: str
    band: str
    states: tuple[str, ...]
    kev: bool
    epss: float | None
    cvss: float | None
    reason: str


# The states that allow action, rule names, bands, inclusive thresholds, order and wording.
SURE = ("confirmed", "verified_exploitable")
KNOWN_BY = {
    "confirmed": "the installed version is confirmed from the device's own package database",
    "verified_exploitable": "exploitability has been verified on this asset",
    "": "the version is inferred from a banner and may already be patched by a backport",
}
UNVERIFIED = "{cve} would matter if it is really installed, but {known}. It belongs in the verification queue rather than the patch queue."
TABLE = [
    Row("verified-exploitable", "p1", ("verified_exploitable",), False, None, None, "Exploitability of {cve} has been verified on this asset — the strongest evidence the system produces."),
    Row("kev-actively-exploited", "p1", (), True, None, None, "CISA lists {cve} as known exploited — attackers are using it now, so it is P1 regardless of how the version was identified."),
    Row("actionable-high-epss", "p1", SURE, False, 0.10, None, "EPSS puts exploitation of {cve} at {epss} in the next 30 days (at or above the 10% threshold), and {known}."),
    Row("actionable-critical-cvss", "p2", SURE, False, None, 9.0, "CVSS rates {cve} critical at {cvss}, and {known}. No exploitation has been observed in the wild, so it is scheduled rather than dropped on the analyst today."),
    Row("actionable-elevated-epss", "p2", SURE, False, 0.01, None, "EPSS puts exploitation of {cve} at {epss.1} in the next 30 days (above the 1% elevated line), and {known}."),
    Row("actionable-high-cvss", "p2", SURE, False, None, 7.0, "CVSS rates {cve} high at {cvss}, and {known}."),
    Row("probable-high-epss", "p2", (), False, 0.10, None, "EPSS puts exploitation of {cve} at {epss} in the next 30 days, but {known}. Verify the installed version by logging in — this cannot be P1 until it is confirmed."),
    Row("actionable-moderate", "p3", SURE, False, None, None, "{Known}, but {cve} is neither severe nor likely to be exploited on the published evidence."),
    Row("probable-severe-unverified", "p3", (), False, None, 7.0, UNVERIFIED),
    Row("probable-severe-unverified", "p3", (), False, 0.01, None, UNVERIFIED),
    Row("probable-unverified", "p4", ("probable",), False, None, None, "{Known}, and {cve} is neither severe nor likely to be exploited. Informational until something else changes."),
    Row("insufficient-signal", "p4", (), False, None, None, "Neither CVSS nor EPSS is published for {cve} and it is not known to be exploited, so there is nothing yet to raise it on."),
]
FLOOR = ("p2", "kev-floor", "Raised to P2: {cve} is in CISA's known-exploited catalog, which no other rule may put below P2 (rule '{rule}' would have given {BAND}).")


def priority_of(cve: Column, state: Column, kev: Column, epss: Column, cvss: Column, rows: list[Row] | None = None, reasons: bool = True) -> Column:
    """(priority, priority_rule, priority_reason) of a finding. What is known to be exploited never falls below the floor.

    Without ``reasons``, which cost most of the time, they are null.
    """
    known = F.coalesce(*[F.when(state == s, text) for s, text in KNOWN_BY.items() if s], F.lit(KNOWN_BY[""]))
    words = {"cve": cve, "known": known, "Known": capitalized(known), "epss": percent(epss, 0), "epss.1": percent(epss, 1), "cvss": cvss.cast("string")}

    def filled(template: str, **fixed: str) -> Column:
        if not reasons:
            return F.lit(None).cast("string")
        parts = re.split(r"\{([^}]+)\}", template)  # text and names in turn
        return F.concat(*[(F.lit(fixed[p]) if p in fixed else words[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    def verdict(band: str, rule: str, reason: Column) -> Column:
        return F.struct(F.lit(band).alias("priority"), F.lit(rule).alias("priority_rule"), reason.alias("priority_reason"))

    def holds(r: Row) -> Column:
        asked = [state.isin(*r.states)] if r.states else []
        asked += [kev] if r.kev else []
        asked += [score >= least for score, least in ((epss, r.epss), (cvss, r.cvss)) if least is not None]
        out = F.lit(True)
        for condition in asked:
            out = out & F.coalesce(condition, F.lit(False))
        return out

    out = []
    for r in TABLE if rows is None else rows:
        given = verdict(r.band, r.rule, filled(r.reason))
        if r.band > FLOOR[0]:
            given = F.when(kev, verdict(*FLOOR[:2], filled(FLOOR[2], rule=r.rule, BAND=r.band.upper()))).otherwise(given)
        out.append(F.when(holds(r), given))
    return F.coalesce(*out)


def with_priority(matches: DataFrame, reasons: bool = True) -> DataFrame:
    """Adds priority, priority_rule and priority_reason to rows with cve_id, confidence_state, kev, epss and cvss_score."""
    found = priority_of(*[F.col(c) for c in ("cve_id", "confidence_state", "kev", "epss", "cvss_score")], reasons=reasons)
    return matches.withColumn("__p", found).select(*matches.columns, "__p.priority", "__p.priority_rule", "__p.priority_reason")
