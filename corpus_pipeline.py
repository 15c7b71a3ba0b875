"""The training-corpus pipeline: documents in, packed sequences out.

Toxic documents go, lines that many documents share go, one document of each near-duplicate group stays, sources are mixed
to target weights, and the result is packed into length buckets: sequences with their text, in batches. Each stage is written
as Parquet to the shared folder and read again as the next one's documents.

What every stage does with odd input: an empty table gives an empty one; null ids, sources and languages stay null (a null id is
one document that sorts before all others, a null source the source ``''``); null, empty and blank texts are kept by the
filtering stages; texts of any length are read whole; further columns, of any name, go through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm import length_buckets, line_dedup, minhash, mixing, toxicity
from harborlight.llm.common import load, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go, all others stay as they are; the scorer is fitted on the labelled ones. Repeated rows are
    judged alike. Without labels nothing goes."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents hold go, but in the document of the largest id. Rows stay, even those left without text.
    ``n_chars``, where there is such a column, is the length of what is left (null for a null text)."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; rows that repeat an id become one, the
    smallest. Texts without words are duplicates of nothing."""
    return minhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and its hash say (possibly never), in shuffled order. Rows that repeat an
    id get the same count."""
    return mixing.mix_sources(docs, weights=mixing.WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens in batches under the token budget; a row per sequence, copies stay apart by ``row``."""
    return length_buckets.pack_lengths(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL expresses neither the learned scorer nor the bucket boundaries; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
