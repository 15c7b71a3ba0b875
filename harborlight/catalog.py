"""All queries of the library but those of the optional subpackage."""

from __future__ import annotations

from .plans import domain, further, generic, readers, streams


def queries():
    return domain.QUERIES | further.QUERIES | generic.QUERIES | readers.QUERIES | streams.QUERIES


def oracle_sql():
    return domain.ORACLES | further.ORACLES | generic.ORACLES | readers.ORACLES | streams.ORACLES
