"""Exact top-k inner-product search by columnar branch and bound.

Candidates lie in vertical layout (one row per dimension, the dimensions of most energy first). Inner products grow
dimension block by dimension block; after each block the mass left on both sides bounds what a candidate can still gain
(Cauchy-Schwarz), and candidates whose bound lies below the k-th best known score are compacted away.

The candidates are searched in rounds, each over ``GROWTH`` times as many as all before it. After a round every query knows
the k-th best score so far; the next round's parts begin with that bound and give back only what reaches it, about
``GROWTH * k`` rows of a query however many parts there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Candidates and queries of a task, about; tasks there are at least, so that small tables spread too.
PART_ROWS, QUERY_ROWS, LEAST_PARTS = 4096, 4096, 24
QUERY_SLICE = 128
GROWTH = 16
RESULT = "query_id long, vec_id long, score long"


def _integers(col: pa.ChunkedArray, dim: int, scale: float) -> np.ndarray:
    flat = np.asarray(col.combine_chunks().flatten(), np.float64) if dim else np.empty(0)
    return np.floor(flat * scale).reshape(len(col), dim)


def _unique_rows(ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by id; of rows that repeat an id, the one of the smallest vector."""
    if len(np.unique(ids)) == len(ids):
        order = np.argsort(ids)
        return ids[order], m[order]
    order = np.lexsort([*m.T[::-1], ids])
    ids, m = ids[order], m[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], m[first]


def _exactly(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in the narrowest type in which every partial sum is exact."""
    most = max(1, q.shape[1]) * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0))
    if most < 2**24:
        return q.astype(np.float32), c.astype(np.float32)
    if most < 2**53:
        return q, c
    if most < 2**62:
        return q.astype(np.int64), c.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(q), whole(c)


class Searcher:
    """Branch and bound over one block of candidates."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, block: int):
        n, dim = c.shape
        f = c.astype(np.float64)
        self.order = np.argsort(-(f * f).sum(0), kind="stable")
        self.ids, self.columns = ids, np.ascontiguousarray(c.T[self.order])
        self.cuts = [*range(0, dim, block), dim] if dim else [0]
        mass = (f.T[self.order]) ** 2
        self.left = np.stack([np.sqrt(mass[e:].sum(0)) for e in self.cuts[1:]]) if dim else np.zeros((0, n))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray | None = None):
        """``floors``: scores below which a query wants nothing (NaN: none)."""
        q = q[:, self.order]
        f = q.astype(np.float64) ** 2
        q_left = np.stack([np.sqrt(f[:, e:].sum(1)) for e in self.cuts[1:]]) if len(self.cuts) > 1 else np.zeros((0, len(q)))
        for s in range(0, len(q), QUERY_SLICE):
            part = slice(s, s + QUERY_SLICE)
            end = self.cuts[1] if len(self.cuts) > 1 else 0
            first = q[part, :end] @ self.columns[:end] if end else np.zeros((len(q[part]), len(self.ids)), np.int64)
            for i, sums in enumerate(first, s):
                floor = None if floors is None or np.isnan(floors[i]) else float(floors[i])
                yield i, *self._one(q_ids[i], q[i], q_left[:, i], sums, k, floor)

    def _one(self, q_id: int, q: np.ndarray, q_left: np.ndarray, sums: np.ndarray, k: int, floor: float | None):
        own = np.searchsorted(self.ids, q_id)
        at = np.arange(len(self.ids))
        if own < len(self.ids) and self.ids[own] == q_id:
            at = np.delete(at, own)
            sums = np.delete(sums, own)
        worst = floor
        for b in range(1, len(self.cuts) - 1):
            slack = q_left[b - 1] * self.left[b - 1][at] * (1 + 1e-9) + 0.5
            if len(at) > k or worst is not None:
                if worst is None:  # complete the most promising to have a score that k candidates reach
                    some = np.argpartition(sums, len(sums) - k)[-k:]
                    rest = slice(self.cuts[b], None)
                    worst = float((sums[some] + q[rest] @ self.columns[rest, at[some]]).min())
                alive = sums + slack >= worst
                at, sums, slack = at[alive], sums[alive], slack[alive]
                if len(at) > k:
                    low = sums - slack
                    worst = max(worst, float(np.partition(low, len(low) - k)[len(low) - k]))
            dims = slice(self.cuts[b], self.cuts[b + 1])
            sums = sums + q[dims] @ self.columns[dims, at]
        if floor is not None:
            keep = sums >= floor
            at, sums = at[keep], sums[keep]
        if len(at) > k:
            edge = np.partition(sums, len(sums) - k)[len(sums) - k]
            keep = sums >= edge
            at, sums = at[keep], sums[keep]
        best = np.lexsort((self.ids[at], -sums))[:k]
        return self.ids[at[best]], sums[best]


def _cell(k: int, scale: float, block: int):
    def run(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy()
        m = _integers(t.column("vec"), dim, scale)
        floor_of = {int(i): f for i, f in zip(ids[asks], t.column("floor").filter(pa.array(asks)).to_pylist(), strict=True) if f is not None}
        q_ids, q = _unique_rows(ids[asks], m[asks])
        floors = np.array([floor_of.get(int(i), np.nan) for i in q_ids], np.float64)
        c_ids, c = _unique_rows(ids[~asks], m[~asks])
        found: list[tuple] = []
        if len(q_ids) and len(c_ids):
            q, c = _exactly(q, c)
            for i, vecs, scores in Searcher(c_ids, c, block).search(q_ids, q, k, floors):
                found.append((np.full(len(vecs), q_ids[i]), vecs, scores))
        cols = [np.concatenate([f[j] for f in found]) if found else np.empty(0) for j in range(3)]
        scores = [min(max(int(x), -(2**63)), 2**63 - 1) for x in cols[2]] if cols[2].dtype == object else cols[2].astype(np.int64)
        return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": pa.array(scores, pa.int64())})

    return run


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    scale: float = 64.0,
    block: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for every row that ``is_query`` selects.

    Components are floor(scale * x). Score: integer inner product; ties go to the smaller id.

    * Rows with a null id, a null vector or a null or non-finite component take no part; only vectors of equal length meet.
      Rows that repeat an id count once, with the smallest vector. Fewer than k others: all of them. Scores beyond 64 bits
      stay at the end of the range.
    * Candidates are dealt by hash into parts, queries into blocks; every query block meets every part in a task of its own,
      so the work spreads however many queries there are and no task holds more than two blocks.
    """
    x = F.col("vec")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rows = rows.withColumn("dim", F.size("vec"))
    n = rows.agg(F.count("*").alias("all"), F.count_if("asks").alias("asks")).first()
    parts, blocks = max(LEAST_PARTS, -(-n["all"] // PART_ROWS)), max(1, -(-n["asks"] // QUERY_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("floor", F.lit(None).cast("double"))
    ends = [parts]
    while ends[0] > GROWTH:
        ends.insert(0, -(-ends[0] // GROWTH))
    best, floors = None, None
    for low, high in zip([0, *ends], ends, strict=False):
        cand = rows.filter((F.col("part") >= low) & (F.col("part") < high)).select("id", "dim", "vec", F.lit(False).alias("asks"), "floor", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"))
        asks = rows.filter("asks")
        if floors is not None:
            asks = asks.drop("floor").join(floors, "id", "left")
        some = F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))
        asks = asks.select("id", "dim", "vec", "asks", "floor", F.explode(some).alias("part"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("qb"))
        near = cand.unionByName(asks).groupBy("dim", "part", "qb").applyInArrow(_cell(k, scale, block), RESULT)
        best = _best(near if best is None else near.unionByName(best.select(*near.columns)), k)
        if high < parts:
            best = stored(best)
            # scores beyond 2**53 are not exact as a double, and those at the end of the range may be larger than they say
            floors = best.filter((F.col("rank") == k) & (F.abs("score") < 2**53)).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    return best


def _best(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
