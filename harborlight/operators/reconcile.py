"""Reconciling discovered assets with an authoritative inventory: who manages what, and what nobody manages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hostname, squashed_hostname

# Confidences by outcome.
STRONG, WEAK, STALE, AMBIGUOUS, UNMANAGED_STRONG, UNMANAGED_WEAK = 0.95, 0.6, 0.6, 0.3, 0.9, 0.5
# Wording of the findings.
REASONS = {
    "disagree": "strong anchors disagree: this record's serial and MAC point at different assets",
    "squash": "hostname matches only after punctuation is removed — likely the same device, but not deterministically",
    "stale": "no discovered asset matches this record; the device may be switched off rather than gone",
    "entangled": "a CMDB record may refer to this asset but could not be matched confidently; not counted as unmanaged",
    "unmatchable": "no serial, MAC or hostname for this asset, so it cannot be looked up in the CMDB at all; not counted as unmanaged",
    "unmanaged_strong": "no CMDB record matches this asset's serial or MAC",
    "unmanaged_weak": "no CMDB record matches this asset's hostname, and it has no serial or MAC to check — the CMDB may simply spell it differently",
}


def _key(tier: Column, value: Column) -> Column:
    return F.when(tier == "serial", F.upper(F.btrim(value))).when(tier == "mac", F.lower(F.btrim(value))).when(tier == "hostname", short_hostname(value)).otherwise(squashed_hostname(value))


def _long(rows: DataFrame, owner: str, anchors: Column) -> DataFrame:
    """(tenant_id, owner, tier, key), a row per anchor; hostnames give two tiers. Empty keys are left out."""
    out = rows.select("tenant_id", owner, F.explode(anchors).alias("a")).filter("a.value is not null and a.value <> ''")
    return out.select("tenant_id", owner, F.col("a.tier").alias("tier"), _key(F.col("a.tier"), F.col("a.value")).alias("key")).filter("key <> ''").distinct()


def asset_keys(assets: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Keys of active assets from their identifiers."""
    live = assets.filter("status = 'active'").select("tenant_id", "asset_id")
    known = identifiers.filter(F.col("kind").isin("serial", "mac", "hostname")).join(live, ["tenant_id", "asset_id"])
    tiers = F.when(F.col("kind") == "hostname", F.array(F.lit("hostname"), F.lit("squash"))).otherwise(F.array("kind"))
    return _long(known, "asset_id", F.transform(tiers, lambda t: F.struct(t.alias("tier"), F.col("value").alias("value"))))


def record_keys(records: DataFrame) -> DataFrame:
    one = lambda tier, c: F.struct(F.lit(tier).alias("tier"), F.col(c).alias("value"))
    return _long(records, "record_id", F.array(one("serial", "serial"), one("mac", "mac"), one("hostname", "hostname"), one("squash", "hostname")))


def record_outcomes(records: DataFrame, assets: DataFrame, identifiers: DataFrame) -> DataFrame:
    """One row per record: category, confidence, reason, strength, asset_id (if linked), matched_on, candidates.

    Serial and MAC settle it if they agree on one asset; else a name that exactly one asset answers to; anything less
    certain is ambiguous. Records and assets meet in one equi-join on (tenant, tier, key); a key that very many assets share
    is a name, never a strong anchor, and adds rows only for the records that use it.
    """
    pairs = record_keys(records).join(asset_keys(assets, identifiers), ["tenant_id", "tier", "key"])
    strong = F.col("tier").isin("serial", "mac")
    hits = pairs.groupBy("tenant_id", "record_id").agg(
        F.array_sort(F.collect_set(F.when(strong, F.col("asset_id")))).alias("strong"),
        F.array_sort(F.collect_set(F.when(F.col("tier") == "hostname", F.col("asset_id")))).alias("named"),
        F.array_sort(F.collect_set(F.when(F.col("tier") == "squash", F.col("asset_id")))).alias("squashed"),
        F.collect_set(F.when(strong, F.col("tier"))).alias("tiers"),
    )
    none = F.array().cast("array<bigint>")
    rows = records.select("tenant_id", "record_id", "external_id", "hostname").join(hits, ["tenant_id", "record_id"], "left")
    for c in ("strong", "named", "squashed"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    n = {c: F.size(c) for c in ("strong", "named", "squashed")}
    case = (
        F.when(n["strong"] == 1, "strong")
        .when(n["strong"] > 1, "disagree")
        .when(n["named"] == 1, "weak")
        .when(n["named"] > 1, "several")
        .when(n["squashed"] > 0, "squash")
        .otherwise("stale")
    )
    rows = rows.withColumn("case", case)
    linked = F.col("case").isin("strong", "weak")
    on = F.when(F.col("case") == "strong", F.filter(F.array(F.lit("serial"), F.lit("mac")), lambda t: F.array_contains("tiers", t))).when(F.col("case") == "weak", F.array(F.lit("hostname")))
    matched_on = F.coalesce(on, F.array().cast("array<string>"))
    candidates = F.when(F.col("case") == "disagree", F.col("strong")).when(F.col("case") == "several", F.col("named")).when(F.col("case") == "squash", F.col("squashed")).otherwise(none)
    reason = (
        F.when(linked, F.concat(F.lit("matched on "), F.array_join(matched_on, ", ")))
        .when(F.col("case") == "several", F.concat(F.lit("several assets answer to the name '"), short_hostname(F.col("hostname")), F.lit("'; a name is not an identity")))
    )
    for c in ("disagree", "squash", "stale"):
        reason = reason.when(F.col("case") == c, F.lit(REASONS[c]))
    return rows.select(
        "tenant_id",
        "record_id",
        "external_id",
        F.when(linked, "matched").when(F.col("case") == "stale", "stale").otherwise("ambiguous").alias("category"),
        F.when(F.col("case") == "strong", STRONG).when(F.col("case") == "weak", WEAK).when(F.col("case") == "stale", STALE).otherwise(AMBIGUOUS).alias("confidence"),
        reason.alias("reason"),
        F.when(linked, F.col("case")).alias("strength"),
        F.when(F.col("case") == "strong", F.element_at("strong", 1)).when(F.col("case") == "weak", F.element_at("named", 1)).alias("asset_id"),
        matched_on.alias("matched_on"),
        candidates.alias("candidates"),
    )


def asset_outcomes(outcomes: DataFrame, assets: DataFrame, identifiers: DataFrame) -> DataFrame:
    """One row per active asset: category, confidence, reason, management_state.

    A link beats everything; an asset that an unresolved record may mean, or that has no anchor to look up, is never called
    unmanaged.
    """
    live = assets.filter("status = 'active'").select("tenant_id", "asset_id")
    linked = outcomes.filter("asset_id is not null").select("tenant_id", "asset_id").distinct().withColumn("linked", F.lit(True))
    entangled = outcomes.select("tenant_id", F.explode("candidates").alias("asset_id")).distinct().withColumn("entangled", F.lit(True))
    anchors = identifiers.groupBy("tenant_id", "asset_id").agg(
        F.bool_or(F.col("kind").isin("serial", "mac")).alias("strong"), F.bool_or(F.col("kind").isin("serial", "mac", "hostname")).alias("matchable")
    )
    rows = live
    for side in (linked, entangled, anchors):
        rows = rows.join(side, ["tenant_id", "asset_id"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    case = F.when(yes("linked"), "linked").when(yes("entangled"), "entangled").when(~yes("matchable"), "unmatchable").when(yes("strong"), "unmanaged_strong").otherwise("unmanaged_weak")
    rows = rows.withColumn("case", case)
    reason = F.when(F.col("case") == "linked", F.lit(None).cast("string"))
    for c in ("entangled", "unmatchable", "unmanaged_strong", "unmanaged_weak"):
        reason = reason.when(F.col("case") == c, F.lit(REASONS[c]))
    return rows.select(
        "tenant_id",
        "asset_id",
        F.when(F.col("case") == "linked", "matched").when(F.col("case").startswith("unmanaged"), "unmanaged").otherwise("ambiguous").alias("category"),
        F.when(F.col("case") == "unmanaged_strong", UNMANAGED_STRONG).when(F.col("case") == "unmanaged_weak", UNMANAGED_WEAK).when(F.col("case") != "linked", AMBIGUOUS).alias("confidence"),
        reason.alias("reason"),
        F.when(F.col("case") == "linked", "managed").when(F.col("case").startswith("unmanaged"), "unmanaged").otherwise("unknown").alias("management_state"),
    )


def findings(outcomes: DataFrame, per_asset: DataFrame) -> DataFrame:
    """All findings of both sides; a linked asset is reported by its record only."""
    mine = outcomes.select("tenant_id", "category", "confidence", "reason", "asset_id", "record_id", "external_id")
    none = F.lit(None)
    theirs = per_asset.filter("category <> 'matched'").select("tenant_id", "category", "confidence", "reason", "asset_id", none.cast("long").alias("record_id"), none.cast("string").alias("external_id"))
    return mine.unionByName(theirs)


def diff_counts(outcomes: DataFrame, per_asset: DataFrame) -> DataFrame:
    """Per tenant: findings by category, unmanaged assets, ambiguous assets and their share of the assets considered."""
    by_kind = findings(outcomes, per_asset).groupBy("tenant_id").agg(*[F.count_if(F.col("category") == c).alias(c) for c in ("matched", "unmanaged", "stale", "ambiguous")])
    by_asset = per_asset.groupBy("tenant_id").agg(
        F.count("*").alias("assets_considered"), F.count_if(F.col("category") == "ambiguous").alias("ambiguous_assets"), F.count_if(F.col("category") == "unmanaged").alias("shadow_it_count")
    )
    rate = F.coalesce(F.try_divide("ambiguous_assets", "assets_considered"), F.lit(0.0))
    return by_kind.join(by_asset, "tenant_id").withColumn("ambiguous_rate", rate)


def record_fields(records: DataFrame, fields: tuple[str, ...] = ("serial", "mac", "hostname")) -> DataFrame:
    """Records (tenant_id, record_id, source, external_id, payload) with the text fields of their JSON payload; blank ones are null."""
    parsed = F.try_parse_json("payload")
    value = lambda k: F.nullif(F.btrim(F.try_variant_get(parsed, f"$.{k}", "string")), F.lit(""))
    return records.select("tenant_id", "record_id", "source", "external_id", *[value(k).alias(k) for k in fields])


def write_back(records: DataFrame, assets: DataFrame, outcomes: DataFrame, per_asset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new states of both tables: every record with the asset it is linked to now (or none: old links are cleared), every
    asset with its management state (those that were not considered keep theirs). Running it again changes nothing."""
    links = outcomes.select("tenant_id", "record_id", F.col("asset_id").alias("linked_asset_id"))
    states = per_asset.select("tenant_id", "asset_id", F.col("management_state").alias("__state"))
    linked = records.drop("linked_asset_id").join(links, ["tenant_id", "record_id"], "left")
    stated = assets.join(states, ["tenant_id", "asset_id"], "left").withColumn("management_state", F.coalesce("__state", "management_state")).select(*assets.columns)
    return linked, stated
