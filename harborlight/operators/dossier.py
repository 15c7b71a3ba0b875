"""Asset dossiers: one redacted, nested row per asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .redact import project, secret_paths
from .scope import segment_labels

MAX_OBSERVATIONS, MAX_PORTS, MAX_FLAGS, MAX_SERVICES = 500, 100, 40, 40
# Keys that are no facts, and the answers that mean yes.
_NOT_FACTS = ["port", "protocol", "service", "name"]
REACHABILITY = ["internet_facing", "internal_only", "isolated_segment", "unknown"]
FACTS = {
    "server": ["os_name", "os_version"],
    "embedded": ["vendor", "model", "device_family", "firmware_version"],
    "application": ["app_name", "behind_reverse_proxy", "behind_waf"],
}
OTHER_FACTS = ["vendor", "model", "firmware_version"]


def open_port(port: Column, protocol: Column, service: Column) -> Column:
    """(port, protocol, service), or null where the number or protocol is none."""
    n = F.when(port.try_cast("double").between(-1e9, 1e9), port.try_cast("double").cast("int"))
    p = F.lower(F.btrim(F.coalesce(protocol, F.lit("tcp"))))
    ok = n.between(1, 65535) & p.isin("tcp", "udp")
    return F.when(ok, F.struct(n.alias("port"), p.alias("protocol"), service.alias("service")))


def recent(observations: DataFrame, limit: int = MAX_OBSERVATIONS) -> DataFrame:
    """The newest observations of each asset with ``age`` (1: newest)."""
    w = Window.partitionBy("tenant_id", "asset_id").orderBy(F.col("observed_at").desc(), "observation_id")
    return observations.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= limit)


def _newest(rows: DataFrame, by: list[str], value: list[str]) -> DataFrame:
    """Of rows with ``age``, the newest per group."""
    return rows.groupBy(*by).agg(F.min_by(F.struct("age", *value), "age").alias("n")).select(*by, "n.*")


def known_to(managed: DataFrame) -> DataFrame:
    """(tenant_id, asset_id, known_to): the inventories that list an asset."""
    return managed.filter("asset_id is not null").groupBy("tenant_id", "asset_id").agg(F.array_sort(F.collect_set("source")).alias("known_to"))


def assemble(
    assets: DataFrame, identifiers: DataFrame, software: DataFrame, observations: DataFrame, managed: DataFrame, subnets: DataFrame, *,
    max_ports: int | None = MAX_PORTS, max_flags: int | None = MAX_FLAGS, max_services: int | None = MAX_SERVICES,
) -> DataFrame:
    """One row per asset: identifiers, software, exposure, management, facts, flags, services and what was dropped.

    Newest wins. A block holds as many entries as its bound says (None: all); ``truncated`` names those that had more. Blocks are aggregated per asset first and joined on the asset key, so no join multiplies rows. Assets without
    observations have unknown reachability and empty blocks.
    """
    key = ["tenant_id", "asset_id"]
    seen = recent(observations)
    kept = stored(seen.select("observation_id", *key, "age").join(project(seen), "observation_id"))  # read by eight blocks
    fields = kept.select(*key, "age", F.explode("fields").alias("name", "value"))
    reach = F.lower(F.btrim("value"))
    reached = _newest(fields.filter((F.col("name") == "reachability") & reach.isin(REACHABILITY)).withColumn("reachability", reach), key, ["reachability"]).drop("age")
    observed = _newest(fields.filter("name = 'network_segment_label'").withColumn("observed_segment", F.col("value")), key, ["observed_segment"]).drop("age")
    at = lambda k: F.try_element_at("fields", F.lit(k))
    ports = kept.withColumn("p", open_port(at("port"), at("protocol"), at("service"))).filter("p is not null")
    ports = ports.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("age", "p"))), lambda x: x["p"]).alias("open_ports"))
    facts = _newest(fields.filter(~F.col("name").isin(_NOT_FACTS)), [*key, "name"], ["value"])
    facts = facts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("facts"))
    flags = _newest(kept.select(*key, "age", F.explode("flags").alias("name", "value")), [*key, "name"], ["value"])
    flags = flags.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("age", "name", "value"))), lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value"))).alias("security_flags"))
    service = F.coalesce(at("name"), at("service"))
    services = _newest(kept.withColumn("service", service).filter("service is not null"), [*key, "service"], [])
    services = services.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("age", "service"))), lambda x: x["service"]).alias("running_services"))
    counts = kept.groupBy(*key).agg(F.count("*").alias("observations_read"), F.sum("dropped").alias("fields_dropped"))
    ids = identifiers.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "kind", "value"))), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))).alias("identifiers")
    )
    soft = software.filter("is_current").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("name", "version", "cpe", "version_source"))).alias("software"))
    inferred = inferred_segments(identifiers, subnets)
    out = assets.select(*key, "asset_class", "management_state", "identification_confidence")
    for side in (ids, soft, reached, observed, inferred, ports, facts, flags, services, counts, known_to(managed)):
        out = out.join(side, key, "left")
    cut = {c: most for c, most in (("open_ports", max_ports), ("security_flags", max_flags), ("running_services", max_services)) if most is not None}
    truncated = F.filter(F.array(*[F.when(F.size(c) > most, c) for c, most in cut.items()]), lambda c: c.isNotNull()).cast("array<string>")
    out = out.withColumn("truncated", truncated)
    for c, most in cut.items():
        out = out.withColumn(c, F.slice(c, 1, most))
    fact = lambda k: F.try_element_at("facts", F.lit(k))
    context = None
    for cls, names in FACTS.items():
        one = F.to_json(F.struct(*[fact(k).alias(k) for k in names]))
        context = F.when(F.col("asset_class") == cls, one) if context is None else context.when(F.col("asset_class") == cls, one)
    context = context.otherwise(F.to_json(F.struct(*[fact(k).alias(k) for k in OTHER_FACTS])))
    return out.select(
        *key,
        "asset_class",
        "management_state",
        "identification_confidence",
        "identifiers",
        "software",
        F.struct(
            F.coalesce("reachability", F.lit("unknown")).alias("reachability"),
            F.coalesce("observed_segment", "inferred_segment").alias("segment"),
            F.when(F.col("observed_segment").isNotNull(), "observed").when(F.col("inferred_segment").isNotNull(), "inferred").alias("segment_from"),
            F.coalesce("open_ports", F.array().cast("array<struct<port:int,protocol:string,service:string>>")).alias("open_ports"),
        ).alias("exposure"),
        F.coalesce("known_to", F.array().cast("array<string>")).alias("known_to"),
        context.alias("context"),
        F.coalesce("security_flags", F.array().cast("array<struct<key:string,value:string>>")).alias("security_flags"),
        F.coalesce("running_services", F.array().cast("array<string>")).alias("running_services"),
        F.coalesce("observations_read", F.lit(0)).alias("observations_read"),
        F.coalesce("fields_dropped", F.lit(0)).alias("fields_dropped"),
        "truncated",
    )


def inferred_segments(identifiers: DataFrame, subnets: DataFrame) -> DataFrame:
    """(tenant_id, asset_id, inferred_segment): the label of the first mapped address, in identifier order."""
    ips = identifiers.filter("kind = 'ip'").select("tenant_id", "asset_id", F.col("value").alias("address"), "confidence")
    ips = ips.withColumn("target_id", F.concat_ws("|", "tenant_id", "asset_id", "address")).dropDuplicates(["target_id"])
    found = segment_labels(ips, subnets).filter("label is not null")
    return found.groupBy("tenant_id", "asset_id").agg(F.min_by("label", F.struct(-F.col("confidence"), F.col("address"))).alias("inferred_segment"))


def sweep(dossiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dossiers that may leave, and refusals (tenant_id, asset_id, reason): any string that looks like a secret refuses the whole
    dossier, as it means that the projection has a hole. Nothing is repaired."""
    found = dossiers.withColumn("__p", secret_paths(F.to_json(F.struct(*dossiers.columns))))
    reason = F.concat(F.lit("refusing to emit: "), F.array_join("__p", "; "))
    return found.filter(F.size("__p") == 0).drop("__p"), found.filter(F.size("__p") > 0).select("tenant_id", "asset_id", reason.alias("reason"))


def detail(dossiers: DataFrame, findings: DataFrame, timeline: DataFrame, tenant_id: int, asset_id: int) -> dict[str, DataFrame]:
    """What a page about one asset shows: its dossier with a label (of a finding, else a hostname, else the first identifier),
    its findings and its timeline."""
    one = dossiers.filter((F.col("tenant_id") == tenant_id) & (F.col("asset_id") == asset_id))
    label = findings.agg(F.first("label", ignorenulls=True).alias("found_label"))
    host = F.try_element_at(F.filter("identifiers", lambda i: i["kind"] == "hostname"), F.lit(1))["value"]
    first = F.try_element_at("identifiers", F.lit(1))["value"]
    named = one.join(F.broadcast(label)).withColumn("label", F.coalesce("found_label", host, first)).drop("found_label")  # one row each
    return {"dossier": named, "findings": findings, "timeline": timeline}


def derived_provenance(at: Column) -> Column:
    """Where a value comes from that was worked out, not observed."""
    # Names of the derivation.
    return F.struct(
        F.lit("reconciliation").alias("source"),
        F.lit("derived").alias("source_type"),
        F.lit("dossier-assembler").alias("collector"),
        F.lit("projection").alias("collection_method"),
        at.alias("observed_at"),
        at.alias("collected_at"),
        F.lit(1.0).alias("confidence"),
        F.lit("deterministic").alias("derivation"),
    )
