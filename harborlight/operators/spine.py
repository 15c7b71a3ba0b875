"""The append-only observation store: canonical payloads, content hashes, and append-if-absent."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEDUP_KEY = ["tenant_id", "run_id", "source_identifier", "observation_type", "content_hash"]


def canonical_payload(payload: Column) -> Column:
    """JSON with sorted keys and no white space; null if it is no JSON. Integral floats lose their ``.0``."""
    return F.to_json(F.try_parse_json(payload))


@F.pandas_udf(T.StringType())
def canonical_payload_exact(payload: pd.Series) -> pd.Series:
    """As :func:`canonical_payload`, but numbers keep their form (``1.0`` stays ``1.0``): for byte-identical hashes."""

    def one(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    return payload.map(one)


def with_hash(observations: DataFrame, exact: bool = False) -> DataFrame:
    canonical = canonical_payload_exact(F.col("payload")) if exact else canonical_payload(F.col("payload"))
    return observations.withColumn("content_hash", F.sha2(canonical.cast("binary"), 256))


def append_if_absent(batch: DataFrame, store: DataFrame, order: list[str], exact: bool = False) -> DataFrame:
    """The batch with ``content_hash`` and ``created``: false where the store or an earlier row of the batch has the key.

    A null source identifier counts as empty. Only keys of the store are read.
    """
    key = [F.coalesce("source_identifier", F.lit("")).alias("source_identifier") if c == "source_identifier" else F.col(c) for c in DEDUP_KEY]
    known = store.select(*key).distinct().withColumn("known", F.lit(True))
    rows = with_hash(batch, exact).withColumn("__sid", F.coalesce("source_identifier", F.lit("")))
    by = ["tenant_id", "run_id", "__sid", "observation_type", "content_hash"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    out = rows.withColumn("first", first).join(known.withColumnRenamed("source_identifier", "__sid"), by, "left")
    return out.select(*batch.columns, "content_hash", (F.col("first") & F.col("known").isNull()).alias("created"))
