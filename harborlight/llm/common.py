"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_dir, stored  # noqa: F401 - used by the operators through this module

# The six ASCII white-space characters of the text contracts.
WS_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
NO_ID = -(2**63)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pack_row(df: DataFrame) -> DataFrame:
    """One struct column ``__row`` holding every input column, so that no helper column can clash with an input name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def in_row(name: str) -> Column:
    return F.col(f"__row.`{name}`")


def unpack_row(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns packed by :func:`pack_row`, some of them replaced."""
    return df.select(*[replaced[c].alias(c) if c in replaced else in_row(c).alias(c) for c in columns])


def doc_key(col: Column) -> Column:
    """A document id that sorts before all others when it is null."""
    return F.coalesce(col.cast("long"), F.lit(NO_ID))


def key_to_id(col: Column) -> Column:
    return F.when(col != NO_ID, col)


#: Rows handed to a mapping function at once: an Arrow batch may hold 10 000 texts.
SLICE = 500


def map_arrow(df: DataFrame, make, schema: str) -> DataFrame:
    """``mapInArrow`` with a per-task setup: ``make()`` returns a function from record batch to record batches."""

    def run(batches):
        fn = make()
        for batch in batches:
            for i in range(0, max(1, len(batch)), SLICE):
                yield from fn(batch.slice(i, SLICE))

    return df.mapInArrow(run, schema)


#: Words of 64 bits in the bitmap of :func:`maybe_in`: its size is fixed (16 million bits, 4 MB of rows) whatever the tables.
BITMAP_WORDS = 1 << 18


def maybe_in(rows: DataFrame, key: Column, needed: DataFrame, needed_key: Column, flag: str = "__maybe") -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where ``key`` (64-bit hashes) is in no row of ``needed``.

    A bitmap of fixed size over the needed keys is broadcast, so no row moves. It tells most rows that are not needed; where
    very many are needed it tells fewer. An exact join of the flagged rows has to follow.
    """

    def word(h: Column) -> Column:
        return F.pmod(h, F.lit(BITMAP_WORDS))

    def bit(h: Column) -> Column:
        return F.pmod(F.shiftright(h, 18), F.lit(64)).cast("int")

    one = F.lit(1).cast("long")
    words = needed.select(needed_key.alias("__k")).groupBy(word(F.col("__k")).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", one, bit(F.col("__k")))).alias("__bits"))
    hit = F.call_function("shiftright", F.coalesce("__bits", F.lit(0).cast("long")), bit(key)).bitwiseAND(one) == 1
    return rows.withColumn("__word", word(key)).join(F.broadcast(words), "__word", "left").withColumn(flag, hit).drop("__word", "__bits")
