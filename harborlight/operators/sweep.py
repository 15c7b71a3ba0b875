"""The ingest path: captures to observations to assets, behind the scope gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import captures
from . import identity, scope, spine


@dataclass(frozen=True)
class Sweep:
    """What a sweep did. ``refused`` lines and denied targets are part of it."""

    refused: DataFrame
    audit: DataFrame
    observations: DataFrame
    sightings: DataFrame
    outcome: DataFrame


def run(tenant_id: int, run_id: str, sources: DataFrame, authorizations: DataFrame, stored: DataFrame, as_of: Column) -> Sweep:
    """Parse ``sources`` (capture_id, kind, observed_at, text), gate each sighting, append what is new, resolve what was let through.

    The gate runs once per sighting, so a target denied twice is audited twice. ``stored`` holds earlier observations (the
    dedup key columns are read). Sightings are numbered by a hash of their fields, so a re-run gives the same ids and equal
    ones are one sighting.
    """
    records, refused = captures.read_captures(sources)
    order = ["capture_id", "source", "target", "observed_at", "mac", "hostname"]
    numbered = records.withColumn("target_id", F.xxhash64(*order, F.to_json("attributes"))).withColumn("tenant_id", F.lit(tenant_id).cast("long")).dropDuplicates(["target_id"])
    decided = scope.scope_decisions(numbered.withColumn("address", F.col("target")), authorizations, as_of)
    inside = decided.filter("allowed")
    rows = captures.observations_of(inside.drop("cidr", "allowed", "reason", "address")).withColumn("tenant_id", F.lit(tenant_id).cast("long")).withColumn("run_id", F.lit(run_id))
    appended = spine.append_if_absent(rows, stored, ["observed_at", "source"])
    anchors = captures.anchors_of(inside, "target_id").select(F.lit(tenant_id).cast("long").alias("tenant_id"), F.col("target_id").alias("sighting_id"), F.col("seq").cast("long").alias("seq"), "kind", "value", "confidence")
    sightings = identity.upsert_sightings(anchors)
    gate = decided.agg(F.count("*").alias("sightings"), F.count_if(~F.col("allowed")).alias("denied"))
    wrote = appended.agg(F.count_if("created").alias("recorded"), F.count_if(~F.col("created")).alias("duplicates"))
    known = sightings.agg(F.count_distinct("asset_id").alias("assets"), F.count_if(F.col("outcome") == "conflict").alias("conflicts"))
    lines = refused.agg(F.count("*").alias("refused_lines"))
    outcome = gate.join(F.broadcast(wrote)).join(F.broadcast(known)).join(F.broadcast(lines))  # one row each
    return Sweep(refused, scope.audit_rows(decided), appended, sightings, outcome)
