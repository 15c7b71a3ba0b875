"""Table constraints as predicates, and a report of the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The domains and implications of the tables, as SQL predicates by table and name. Null passes, as in SQL.
CONSTRAINTS = {
    "asset": {
        "confidence_range": "identification_confidence between 0 and 1",
        "status_domain": "status in ('active', 'merged')",
        "merged_iff_pointer": "(status = 'merged') = (merged_into is not null)",
        "not_into_itself": "merged_into is null or merged_into <> asset_id",
    },
    "identifier": {"kind_domain": "kind in ('serial', 'cert_fingerprint', 'mac', 'hostname', 'ip')", "confidence_range": "confidence between 0 and 1"},
    "match": {
        "confidence_domain": "confidence_state in ('probable', 'confirmed', 'verified_exploitable')",
        "epss_range": "epss between 0 and 1",
        "cvss_range": "cvss_score between 0 and 10",
        "priority_domain": "priority in ('p1', 'p2', 'p3', 'p4')",
    },
    "scope": {"expires_after": "expires_at is null or expires_at > authorized_at"},
    "insight": {
        "kev_not_hidden": "not (kev_locked_visible and recommendation = 'lower_priority')",
        "kev_not_hidden_by_review": "not (kev_locked_visible and review_recommendation <=> 'lower_priority')",
        "review_recorded": "state = 'proposed' or reviewer is not null",
    },
    "review_event": {"adjust_has_change": "kind <> 'adjust' or recommendation is not null", "state_changes_or_repeats": "from_state is not null"},
}


def violations(rows: DataFrame, table: str, key: str) -> DataFrame:
    """(constraint, key) for every row and constraint it breaks. One pass: a row's broken constraints are exploded."""
    broken = [F.when(~F.expr(p), F.lit(name)) for name, p in CONSTRAINTS[table].items()]
    names = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return rows.select(F.explode(names).alias("constraint"), F.col(key).alias("key"))


def violation_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [violations(df, name, key).groupBy("constraint").count().select(F.lit(name).alias("table_name"), "constraint", F.col("count").alias("n_rows")) for name, (df, key) in tables.items()]
    return reduce(DataFrame.unionByName, parts)
