"""Network containment: the scope gate and subnet labels. The most specific network that holds an address decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import address_key, masked, network


def _networks(rules: DataFrame) -> DataFrame:
    """Rules with bounds; those that are no network are left out (see :func:`invalid_rules`)."""
    return rules.withColumn("net", network(F.col("cidr"))).filter("net is not null").select("*", "net.low", "net.high", "net.bits")


def invalid_rules(rules: DataFrame, max_label_chars: int = 100) -> DataFrame:
    """Rules that are refused, with the reason: no network in CIDR notation, host bits set, or a label that is empty or too long."""
    cidr = F.btrim("cidr")
    reason = F.when(network(cidr).isNull(), F.concat(F.lit("not a network in CIDR notation: "), F.coalesce(F.left(cidr, F.lit(60)), F.lit("null"))))
    if "label" in rules.columns:
        label = F.btrim(F.regexp_replace("label", r"\s+", " "))
        reason = reason.when(F.coalesce(label, F.lit("")) == "", "empty label").when(F.length(label) > max_label_chars, f"label longer than {max_label_chars} characters")
    return rules.withColumn("reason", reason).filter("reason is not null")


def most_specific(targets: DataFrame, rules: DataFrame, address: str, keep: list[str], extra: Column | None = None) -> DataFrame:
    """``targets`` left-joined to the longest network of ``rules`` (same tenant) that holds ``address``.

    ``targets`` needs a unique column ``target_id``. Adds ``cidr`` and the ``keep`` columns of the rule, null if none. Targets
    and rules meet on (tenant, prefix length, prefix), a row per prefix length in use (one row of 129 numbers at most tells
    which), so no pair is compared that does not match, however many rules there are.
    """
    nets = _networks(rules if extra is None else rules.filter(extra)).select("tenant_id", "cidr", "low", "bits", *keep)
    used = F.broadcast(nets.agg(F.coalesce(F.collect_set("bits"), F.array().cast("array<int>")).alias("used")))  # one row
    rows = targets.select("target_id", "tenant_id", address_key(F.col(address)).alias("__a")).join(used)
    spread = rows.withColumn("bits", F.explode("used")).select("target_id", "tenant_id", "bits", masked(F.col("__a"), F.col("bits")).alias("low"))
    best = spread.join(nets, ["tenant_id", "bits", "low"]).groupBy("target_id").agg(F.max_by(F.struct("cidr", *keep), F.struct("bits", "cidr")).alias("r"))
    return targets.join(best, "target_id", "left").select(*targets.columns, F.col("r.cidr").alias("cidr"), *[F.col(f"r.{k}").alias(k) for k in keep])


def scope_decisions(targets: DataFrame, authorizations: DataFrame, as_of: Column) -> DataFrame:
    """Every target with ``allowed``, the authorising network and a reason; whatever no current network holds is denied."""
    live = F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    rows = most_specific(targets, authorizations, "address", [], live)
    allowed = F.col("cidr").isNotNull()
    return rows.withColumn("allowed", allowed).withColumn("reason", F.when(allowed, F.concat(F.lit("authorized by "), F.col("cidr"))).otherwise(F.lit("no active authorization covers this address")))


def audit_rows(decisions: DataFrame) -> DataFrame:
    """One audit entry per decision; a target denied twice is written twice."""
    return decisions.select(
        "tenant_id", F.lit("scope.authorize").alias("action"), F.col("address").alias("resource"), F.when(F.col("allowed"), "success").otherwise("denied").alias("result"), "reason"
    )


def segment_labels(targets: DataFrame, subnets: DataFrame) -> DataFrame:
    """Targets with the label of their longest subnet, null where none is mapped."""
    return most_specific(targets, subnets, "address", ["label"])
