"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate (its target share of the output over the rows it has). A document's count is the
inverse of the Poisson distribution with that mean, at a uniform number made from a keyed hash of its id; the document is
repeated that often, and all copies are shuffled globally by a second hash. A rate above ``PIECE_RATE`` is cut into equal
pieces, each with a hash of its own: a sum of Poisson counts is a Poisson count, so the distribution is the same, and no
row ever holds more than one piece's table or copies. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_row, pack_row, stored, unpack_row

SEED = "mix-1"
#: Weights of the production mixture: sources not named have weight 1.
WEIGHTS = {"src0": 2.0, "src1": 0.5, "src2": 1.5, "src3": 3.0}
#: Largest mean of one inversion. The count of a piece stays below ``STRIDE`` with all but a probability below 2**-52.
PIECE_RATE, STRIDE = 32.0, 128
#: Pieces of a document are made in blocks of so many.
PIECES = 4096
#: 52 bits of the hash: every value is exact as a double.
UNIT = float(2**52)


def _digits(*parts: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, n), 16, 10)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (_digits(*parts, n=13).cast("double") + 0.5) / UNIT


def poisson(rate: Column, u: Column) -> Column:
    """The inverse of the Poisson distribution: how many of its sums at 0, 1, 2, ... lie below ``u``.

    A running sum, so nothing is kept but three numbers; summed from logarithms up to where the rest is below any 52-bit
    uniform. A rate of 0 gives 0.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    below = lambda total: F.when(total < u, 1).otherwise(0)
    start = F.struct((-rate).alias("lp"), first.alias("sum"), below(first).alias("n"))

    def step(a: Column, k: Column) -> Column:
        lp = a["lp"] + F.log(rate) - F.log(k.cast("double"))
        total = a["sum"] + F.exp(lp)
        return F.struct(lp.alias("lp"), total.alias("sum"), (a["n"] + below(total)).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["n"]).otherwise(0)


def source_rates(docs: DataFrame, source: Column, weights: dict[str, float] | None, default_weight: float, total: int | None) -> DataFrame:
    """One row per source: rows, weight, and mean repetition rate."""
    given = weights or {}
    if default_weight < 0 or any(w < 0 for w in given.values()):
        raise ValueError("weights must not be negative")
    counts = docs.select(F.coalesce(source.cast("string"), F.lit("")).alias("__source")).groupBy("__source").agg(F.count("*").alias("__n"))
    named = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in given.items()], "__source string, __given double")
    weighed = counts.join(named, "__source", "left").select("__source", "__n", F.coalesce("__given", F.lit(float(default_weight))).alias("__w"))
    weighed = stored(weighed)
    sums = weighed.agg(F.sum("__n").alias("rows"), F.sum("__w").alias("weights")).first()
    goal, shares = float(total if total is not None else sums["rows"] or 0), sums["weights"] or 0.0
    return weighed.withColumn("__rate", F.col("__w") * goal / shares / F.col("__n") if shares > 0 else F.lit(0.0))


def _copies(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights, default_weight: float, total: int | None, seed: str) -> DataFrame:
    # the rates are a table of a few numbers per source; whether it is broadcast is left to Spark's check of its size
    rates = source_rates(docs, F.col(f"`{source_col}`"), weights, default_weight, total).select("__source", "__rate")
    rows = pack_row(docs).withColumn("__source", F.coalesce(in_row(source_col).cast("string"), F.lit(""))).join(rates, "__source")
    # ids are hashed; a row without one is told apart by its text
    name = F.coalesce(in_row(id_col).cast("string"), F.md5(F.coalesce(in_row(text_col), F.lit("")).cast("binary")))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("__rate") / PIECE_RATE)).cast("long")
    rows = rows.filter("__rate > 0").select("__row", name.alias("__name"), (F.col("__rate") / pieces).alias("__rate"), pieces.alias("__pieces"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = rows.withColumn("__block", F.explode(F.sequence(zero, ((F.col("__pieces") - 1) / PIECES).cast("long"))))
    upto = F.least(F.col("__pieces"), (F.col("__block") + 1) * PIECES)
    rows = rows.withColumn("__piece", F.explode(F.sequence(F.col("__block") * PIECES, upto - 1)))
    u = F.when(F.col("__piece") == 0, uniform(F.lit(seed), F.col("__name"))).otherwise(uniform(F.lit(seed), F.col("__name"), F.lit("piece"), F.col("__piece").cast("string")))
    rows = rows.withColumn("__u", u).withColumn("__count", poisson(F.col("__rate"), F.col("__u"))).filter("__count > 0")
    rows = rows.select("__row", "__name", "__piece", F.explode(F.sequence(one, F.col("__count").cast("long"))).alias("__copy"))
    rows = rows.select("__row", "__name", (F.col("__piece") * STRIDE + F.col("__copy")).alias("__copy"))
    key = _digits(F.lit(seed), F.lit("order"), F.col("__name"), F.col("__copy").cast("string"), n=15).cast("long")
    return rows.withColumn("__key", key)


def _shuffled(df: DataFrame) -> DataFrame:
    """Rows go to a partition by hash and lie in it in hash order: a global shuffle with one exchange and no sampling pass."""
    return df.repartition(F.col("__key"), F.col("__name"), F.col("__copy")).sortWithinPartitions("__key", "__name", "__copy")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    total: int | None = None,
    seed: str = SEED,
) -> DataFrame:
    """The mixture, with the columns of ``docs``: a row for each copy, in shuffled order.

    * ``weights``: target shares by source, in any unit; sources not named have ``default_weight``. A null source is the
      source ``''``. ``total``: expected rows of the output (default: as many as ``docs`` has).
    * A source of weight 0 goes. An empty table stays empty. Rows that repeat an id get the same count; nulls in other
      columns, empty and long texts and further columns of any name stay as they are.
    * No stage gathers a source: rates are a small table, the shuffle is by a hash of id and copy, so a source with a third
      of all rows, or one text repeated often, spreads like any other. The copies of one document are made where it lies,
      one after the other, in blocks: their number may be as large as a rare source's rate asks for, at constant memory.
    """
    rows = _shuffled(_copies(docs, id_col, source_col, text_col, weights, default_weight, total, seed))
    return unpack_row(rows, docs.columns)


def mix_digest(docs: DataFrame, *, weights: dict[str, float] | None = None, seed: str = SEED, **more) -> DataFrame:
    """One row per copy, in shuffled order: doc_id, source, copy, shuffle_key, text_sha256. Only id, source and text are read.

    ``copy`` counts from 1 (each piece of a large rate from a multiple of ``STRIDE``). A null text has the digest of the
    empty one; null ids and sources stay null; see :func:`mix_sources` for the rest.
    """
    docs = docs.select("doc_id", "source", "text")
    rows = _shuffled(_copies(docs, "doc_id", "source", "text", weights, more.get("default_weight", 1.0), more.get("total"), seed))
    return rows.select(
        in_row("doc_id").cast("long").alias("doc_id"),
        in_row("source").alias("source"),
        F.col("__copy").cast("long").alias("copy"),
        F.col("__key").alias("shuffle_key"),
        F.sha2(F.coalesce(in_row("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


ORACLE_SQL = f"""
WITH counts AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
weighed AS (
  SELECT s, n, CASE s {' '.join(f"WHEN '{k}' THEN {v!r}" for k, v in WEIGHTS.items())} ELSE 1.0 END::DOUBLE AS w FROM counts
), rates AS (
  SELECT s, w * (sum(n) OVER ())::DOUBLE / (sum(w) OVER ()) / n AS rate FROM weighed
), terms AS (
  SELECT s, rate, k, CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k) END AS step
  FROM rates, range(0, 2000) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)
), logs AS (
  SELECT s, k, sum(step) OVER (PARTITION BY s ORDER BY k) AS lp FROM terms
), cdf AS (
  SELECT s, k, sum(exp(lp)) OVER (PARTITION BY s ORDER BY k) AS c FROM logs
), lists AS (SELECT s, list(c ORDER BY k) AS cs FROM cdf GROUP BY s),
drawn AS (
  SELECT doc_id, source, text, cs,
         ((('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT)::DOUBLE + 0.5) / {2**52}.0 AS u
  FROM documents JOIN lists ON s = coalesce(source, '')
), copies AS (
  SELECT doc_id, source, text, unnest(range(1, 1 + len(list_filter(cs, lambda c: c < u)))) AS copy FROM drawn
)
SELECT doc_id, source, copy::BIGINT AS copy,
       ('0x' || substr(md5('{SEED}:order:' || doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key,
       sha256(coalesce(text, '')) AS text_sha256
FROM copies
"""
