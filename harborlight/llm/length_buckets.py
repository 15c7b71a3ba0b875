"""Packing by optimal length buckets.

Texts are measured and cut into sequences where they are longer than one, the histogram of lengths is summed over all of
them, and dynamic programming over it chooses the bucket boundaries of least padding. Inside each bucket, batches form under
a token budget; every sequence carries its part of the text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN

MAX_LEN, BUCKETS, BUDGET = 2048, 12, 32_768
#: Batches of a shard, about: a part of a bucket whose batches form in one task.
SHARD_BATCHES = 16


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds (lengths that occur) of at most ``buckets`` buckets with the least total padding.

    ``histogram`` has at most one entry per length up to the sequence length, whatever the corpus.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(lengths):
        return []
    count = np.array([histogram[int(k)] for k in lengths], np.int64)
    rows = np.concatenate([[0], np.cumsum(count)])
    mass = np.concatenate([[0], np.cumsum(count * lengths)])
    n = len(lengths)
    # best[j]: least padding of the first j lengths in the buckets so far
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        following, choice = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (mass[j] - mass[:j])
            i = int(cost.argmin())
            if cost[i] < following[j]:
                following[j], choice[j] = cost[i], i
        best = following
        back.append(choice)
    bounds, j = [], n
    for choice in reversed(back):
        if j and choice[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(choice[j])
    return bounds[::-1]


def word_tokens(text: Column) -> Column:
    """Words and one end-of-text token."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)) + 1


def word_slices(text: Column, n_tokens: Column, max_len: int) -> Column:
    """The text in slices of ``max_len`` word tokens (see :func:`word_tokens`); put together they are the text.

    A word goes with the white space before it, the end token with the white space behind the last word, so the slice of a
    lone end token may be empty. Only texts that need more than one slice are searched.
    """
    of_words = F.regexp_extract_all(text, F.lit(rf"(?:[\x20\x09-\x0D]*+{WORD_PATTERN}+){{1,{max_len}}}+"), F.lit(0))

    def cut(words: Column) -> Column:
        used = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
        rest = F.substring(text, used + 1, F.length(text) - used)
        # the end token opens a slice of its own if the words fill theirs
        n = F.floor((n_tokens - 1) / max_len) + 1
        tail = F.element_at(words, -1)
        return F.when(F.size(words) < n, F.concat(words, F.array(rest))).otherwise(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(F.concat(tail, rest))))

    many = F.element_at(F.transform(F.array(of_words), cut), 1)
    return F.when(n_tokens <= max_len, F.array(text)).otherwise(many)


def pack_lengths(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length=word_tokens,
    slices=word_slices,
    max_len: int = MAX_LEN,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """One row per sequence: doc_id, row, chunk, start, n_tokens, text, bucket_len, padding, shard, batch, slot, rows_per_batch.

    * ``length`` measures a text in tokens (default: words and an end token; null or empty: 1). A text longer than
      ``max_len`` becomes sequences of ``max_len`` tokens and a last one; ``start`` is a sequence's first token and ``text``
      its part of the text (``slices``): the parts of a row, in order of ``chunk``, are the whole text.
    * ``row`` numbers the rows of ``docs``, so that rows that repeat an id or are copies of one another stay apart; it is
      stable for one layout of the input's files, nothing else depends on their order. Null ids stay null.
    * The histogram has at most ``max_len`` entries, so it is summed by map-side combining and read by the driver.
    * A batch holds ``budget // bucket_len`` rows (one at least). Sequences are dealt by a hash of (row, chunk) into shards of
      bounded size and batches form inside a shard, so neither a bucket that holds most of the corpus nor a text repeated
      very often is one task; the last batch of a shard may be smaller. (bucket_len, shard, batch) names a batch and
      ``slot`` a place in it. An empty table has no sequences.
    """
    if max_len < 1 or buckets < 1 or budget < 1:
        raise ValueError("max_len, buckets and budget must be positive")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), length(text).cast("long").alias("all"), F.monotonically_increasing_id().alias("row"))
    last = ((F.col("all") - 1) / max_len).cast("long")
    tokens = F.least(F.lit(max_len).cast("long"), F.col("all") - F.col("chunk") * max_len)
    counted = rows.select("all", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk")).select(tokens.alias("n_tokens"))
    histogram = {int(r["n_tokens"]): int(r["count"]) for r in counted.groupBy("n_tokens").count().collect()}
    bounds = optimal_boundaries(histogram, buckets) or [max_len]
    bucket, shards = F.lit(None).cast("long"), F.lit(1).cast("long")
    for upper, lower in zip(reversed(bounds), [*reversed(bounds[:-1]), 0], strict=True):
        members = sum(v for k, v in histogram.items() if lower < k <= upper)
        size = SHARD_BATCHES * max(1, budget // upper)
        bucket = F.when(F.col("n_tokens") <= upper, F.lit(upper).cast("long")).otherwise(bucket)
        shards = F.when(F.col("n_tokens") <= upper, F.lit(-(-members // size) or 1).cast("long")).otherwise(shards)
    rows = rows.select("doc_id", "row", "all", F.posexplode(slices(F.col("text"), F.col("all"), max_len)).alias("chunk", "text"))
    rows = rows.select("doc_id", "row", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk").cast("long") * max_len).alias("start"), tokens.cast("long").alias("n_tokens"), "text")
    mixed = F.xxhash64(F.col("row"), F.col("chunk"))
    rows = rows.withColumn("bucket_len", bucket).withColumn("__mixed", mixed).withColumn("shard", F.pmod(F.shiftrightunsigned("__mixed", 20), shards))
    order = Window.partitionBy("bucket_len", "shard").orderBy("__mixed", "row", "chunk")
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    place = (F.row_number().over(order) - 1).cast("long")
    rows = rows.withColumn("rows_per_batch", per).withColumn("__place", place)
    return rows.select(
        "doc_id", "row", "chunk", "start", "n_tokens", "text", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), "shard",
        F.floor(F.col("__place") / F.col("rows_per_batch")).alias("batch"), F.pmod(F.col("__place"), F.col("rows_per_batch")).alias("slot"), "rows_per_batch",
    )
