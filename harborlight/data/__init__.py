"""Fixed values as small tables: what a device is scanned with, and which payload fields may leave an observation."""

from __future__ import annotations

import csv
from importlib import resources


def table(name: str) -> list[dict[str, str]]:
    """The rows of a packaged table, read at the driver."""
    with (resources.files(__name__) / f"{name}.csv").open(encoding="utf-8", newline="") as lines:
        return list(csv.DictReader(lines))
