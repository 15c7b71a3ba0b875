"""Near-duplicate detection by min-max hashing.

Every permutation gives two signature values, the smallest and the largest, so half the hash evaluations fill a
signature; bands of it find candidates, and every link is confirmed on the full shingle sets.

How the work stays linear and whole:

1. Texts with equal shingle sets are one class (map-side combined), so copies cost nothing further.
2. In every bucket each member is compared with the bucket's smallest member only.
   These pairs are filtered by set size and an 8-bit sketch of the signature (at similarity 0.75 the filter lies more than
   five standard deviations below the mean), then confirmed exactly.
3. Confirmed links become components. Buckets whose members are still in several components are then compared blockwise:
   two blocks of full sets meet in one task, which counts all intersections and gives back only the links that join
   components. So every pair that shares a bucket is either in one component or compared, no bucket is capped, and no
   group gives back all its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, in_row, key_to_id, map_arrow, maybe_in, pack_row, stored, unpack_row
from .components import components
from .wordscan import mix64, texts, windows, words

#: 64 permutations, 128 values, 32 bands of 4: a pair at 0.75 shares no bucket with probability 5e-6.
PERMUTATIONS, BANDS = 64, 32
#: Shingles of a block of a bucket, about.
BLOCK = 200_000
_rng = np.random.Generator(np.random.PCG64(9))
_A = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
# a band takes values of four different permutations, two of them minima
_BAND = np.array([[4 * j % 128, (4 * j + 2) % 128, (4 * j + 45) % 128, (4 * j + 47) % 128] for j in range(BANDS)])
_SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))

FEATURES = "id long, n long, c1 long, c2 long, sketch binary, bands array<long>"


def shingles(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    hashes, _ = words((data or b"").lower())
    if not len(hashes):
        return hashes
    return np.unique(mix64(windows(hashes, min(size, len(hashes))) + np.uint64(min(size, len(hashes)))))


def signature(sh: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, in turn."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 2048):
        v = _A[:, None] * x[None, i : i + 2048] + _B[:, None]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def _features(size: int):
    def make():
        def one(batch):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                sh = shingles(t, size)
                if not len(sh):
                    rows.append((i, 0, None, None, None, None))
                    continue
                sig = signature(sh)
                c1, c2 = mix64(sh).sum(), mix64(sh ^ np.uint64(0x5851F42D4C957F2D)).sum()
                parts = mix64(sig.astype(np.uint64))[_BAND]
                keys = mix64(((parts[:, 0] * np.uint64(3) + parts[:, 1]) * np.uint64(5) + parts[:, 2]) * np.uint64(7) + parts[:, 3] + _SALT)
                rows.append((i, len(sh), int(c1.view(np.int64)), int(c2.view(np.int64)), (sig & 0xFF).astype(np.uint8).tobytes(), keys.view(np.int64).tolist()))
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n", "c1", "c2", "sketch", "bands"])

        return one

    return make


def _least_matches(similarity: float) -> int:
    """Equal sketch bytes below which a pair is no candidate: over five standard deviations below the mean."""
    values = 2 * PERMUTATIONS
    return math.floor(values * (similarity - 5.5 * math.sqrt(similarity * (1 - similarity) / values)))


def _pair_filter(similarity: float):
    least = _least_matches(similarity)

    def make():
        def one(batch):
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(batch), -1) for i in (2, 3))
                ok = pa.array((a == b).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

        return one

    return make


def _size_ok(n, m, similarity: float):
    """Sets of these sizes can reach the similarity."""
    percent = round(100 * similarity)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _likely(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").filter(_size_ok(F.col("na"), F.col("nb"), similarity))
    return map_arrow(both.select("a", "b", "sa", "sb"), _pair_filter(similarity), "a long, b long").distinct()


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def make():
        def one(batch):
            sets = [shingles(t, size).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

        return one

    return map_arrow(docs, make, "id long, set binary")


def narrowed(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The documents whose id is in ``needed``, without moving the texts of most others (see :func:`~.common.maybe_in`)."""
    needed = stored(needed)
    likely = maybe_in(docs, F.xxhash64("id"), needed, F.xxhash64("id")).filter("__maybe")
    return likely.select("id", "text").join(needed, "id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose full sets reach the similarity. Only texts of candidate pairs are read again."""
    percent = round(100 * similarity)

    def make():
        def one(batch):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

        return one

    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(_sets(narrowed(docs, needed), size))
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return stored(map_arrow(both, make, "a long, b long").distinct())


def _block_links(similarity: float):
    """Spanning links of different components between two blocks of one bucket, from rows sorted by block pair.

    Intersections are counted exactly: a document's shingles walk the postings of the block, which gives its
    intersection with all others at once. A pair is looked at in the smallest bucket it shares only.
    """
    percent = round(100 * similarity)

    def compare(t: pa.Table):
        side = t.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            right = left
        rep, comp, key = (t.column(c).to_numpy() for c in ("rep", "comp", "key"))
        if (comp == comp[0]).all():
            return
        bands = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(t.num_rows, -1)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(right)), size[right])
        flat = np.concatenate([sets[j] for j in right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for i in left:
            if (comp[right] == comp[i]).all():
                continue
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(right))
            near = np.flatnonzero((100 * both >= percent * (size[i] + size[right] - both)) & (comp[right] != comp[i]))
            for j in right[near]:
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y and bands[i][bands[i] == bands[j]].min() == key[i]:
                    joined[max(x, y)] = min(x, y)
                    yield int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))

    def run(batches):
        kept: list[pa.Table] = []

        def out(t):
            ids = t.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            pairs = {p for s, e in zip(cuts, cuts[1:], strict=False) for p in compare(t.slice(s, e - s))}
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            t = pa.concat_tables([*kept, pa.Table.from_batches([batch])])
            ids = t.column("block").to_numpy()
            before = np.flatnonzero(ids != ids[-1])
            whole = int(before[-1]) + 1 if len(before) else 0
            if whole:
                yield out(t.slice(0, whole))
            kept = [t.slice(whole)]
        if kept and kept[0].num_rows:
            yield out(kept[0])

    return run


def _across(shared: DataFrame, reps: DataFrame, labels: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links between different components that share a bucket, from buckets still in several components.

    A bucket is cut into blocks of about ``BLOCK`` shingles. Components that fill a block have blocks of their own, all others
    share the pool's; blocks of one component never meet. So a large group of near copies and a few texts beside it cost one
    pass over the group, and only components that are large themselves meet block by block.
    """
    placed = stored(shared.join(labels, shared.rep == labels.id, "left").select("key", "rep", "n", F.coalesce("label", "rep").alias("comp")))
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("mass"))
    large, blocks = F.col("mass") >= BLOCK, F.ceil(F.col("mass") / BLOCK).cast("int")
    # of each bucket only its large components are listed: one for BLOCK shingles at most
    mixed = per.groupBy("key").agg(
        F.count("*").alias("components"),
        F.sum("m").alias("m"),
        F.ceil(F.coalesce(F.sum(F.when(~large, F.col("mass"))), F.lit(0)) / BLOCK).cast("int").alias("pool"),
        F.sort_array(F.collect_list(F.when(large, F.struct("comp", blocks.alias("blocks"))))).alias("large"),
    )
    begin = F.struct(F.col("pool").alias("upto"), F.array().cast("array<struct<comp:bigint,lo:int,hi:int>>").alias("parts"))
    laid = F.aggregate(
        "large",
        begin,
        lambda a, c: F.struct((a["upto"] + c["blocks"]).alias("upto"), F.concat(a["parts"], F.array(F.struct(c["comp"].alias("comp"), a["upto"].alias("lo"), (a["upto"] + c["blocks"]).alias("hi")))).alias("parts")),
    )
    mixed = stored(mixed.filter("m > 2 and components > 1").select("key", "pool", laid.alias("laid")))
    mine = F.try_element_at(F.filter("laid.parts", lambda p: p["comp"] == F.col("comp")), F.lit(1))
    rows = placed.join(mixed, "key").select("key", "rep", "comp", "pool", F.col("laid.upto").alias("blocks"), mine.alias("own"))
    block = F.when(F.col("own").isNull(), F.pmod(F.hash("rep"), F.col("pool"))).otherwise(F.col("own.lo") + F.pmod(F.hash("rep"), F.col("own.hi") - F.col("own.lo")))
    rows = stored(rows.select("key", "rep", "comp", "blocks", block.alias("block"), F.coalesce("own.lo", F.lit(0)).alias("lo"), F.coalesce("own.hi", F.lit(0)).alias("hi")))
    needed = rows.select(F.col("rep").alias("id")).distinct()
    sets = stored(_sets(narrowed(docs, needed), size)).withColumnRenamed("id", "rep")
    rows = rows.join(reps.select("rep", "bands").join(sets, "rep"), "rep")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o < F.col("lo")) | (o >= F.col("hi")))
    pairs = F.transform(
        others,
        lambda other: F.struct(F.xxhash64("key", F.least("block", other), F.greatest("block", other)).alias("block"), F.when(F.col("block") > other, 1).otherwise(0).alias("side")),
    )
    rows = rows.select("key", "rep", "comp", "bands", "set", F.explode(pairs).alias("p")).select("p.block", "p.side", "key", "rep", "comp", "bands", "set")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_block_links(similarity), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of ``size``-word shingles reaches ``similarity``;
    component_id is the smallest id reachable over links, and the document that has it is kept.

    * A text of fewer words is one shingle; null, empty or blank texts have none and are linked with nothing.
    * A null id is one document, smaller than all others, with component_id null. Rows that repeat an id are versions of one
      document: a link of one links the id.
    * Candidates come from bands (see the module); links are confirmed on 64-bit hashes of all shingles.
    """
    plain = docs.select(doc_key(F.col(f"`{id_col}`")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    feats = stored(map_arrow(plain, _features(size), FEATURES))
    full = feats.filter("n > 0")
    reps = stored(full.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    buckets = reps.select("rep", "n", F.explode("bands").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).filter("m > 1").select("key", "hub")
    shared = stored(buckets.join(hubs, "key").select("key", "rep", "n", "hub"))
    star = shared.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    links = _confirmed(stored(_likely(star, reps, similarity)), plain, size, similarity)
    labels = components(links)
    links = links.union(stored(_across(shared, reps, labels, plain, size, similarity)))
    # rows that repeat an id with another text join the versions
    versions = full.join(reps.select("c1", "c2", "rep"), ["c1", "c2"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    if feats.groupBy("id").count().filter("count > 1").limit(1).count():
        links = links.union(versions)
    labels = components(links)
    classes = reps.select("c1", "c2", "rep").join(labels, reps.rep == labels.id, "left").select("c1", "c2", F.coalesce("label", "rep").alias("component"))
    placed = full.join(classes, ["c1", "c2"]).select("id", "n", "component").unionByName(feats.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    return placed.select(
        key_to_id(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        key_to_id(F.col("component")).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` (all columns) with one document of each near-duplicate group; rows that repeat an id become one.

    The ids that go are joined to the documents; texts move only where those ids are too many to be broadcast.
    """
    found = stored(near_duplicates(docs, id_col=id_col, **more).select(doc_key(F.col("doc_id")).alias("__id"), "kept"))
    rows = pack_row(docs).withColumn("__id", doc_key(in_row(id_col)))
    out = rows.join(found.filter("not kept").select("__id").distinct(), "__id", "left_anti")
    repeated = found.filter("kept").groupBy("__id").count().filter("count > 1").select("__id")
    if repeated.limit(1).count():
        many = out.join(repeated, "__id", "left_semi").groupBy("__id").agg(F.min("__row").alias("__row"))
        out = out.join(repeated, "__id", "left_anti").unionByName(many)
    return unpack_row(out, docs.columns)
