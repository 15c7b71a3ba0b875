"""The pipeline's stages against plain versions of each."""

import collections
import hashlib
import math

import corpus_pipeline
from harborlight.llm import mixing
from tests.llm.test_operators import ASCII, WORD, linked


def test_stages(spark, data):
    import pyspark.sql.functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, data))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        seen.append((docs.collect(), out.collect()))
        docs = out
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, data).collect()))
    toxic = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").filter(F.col("toxic") == 1).collect()}
    before, after = seen[0]
    kept = {r.doc_id for r in after}
    assert {str(r) for r in after} <= {str(r) for r in before} and len(before) - len(after) <= 2 * max(1, len(toxic))

    before, after = seen[1]
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    for r in before:
        for x in r.text.split("\n"):
            holders[key(x)].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == r.doc_id) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after) and {r.doc_id for r in after} == kept

    before, after = seen[2]
    label = linked([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in label.items() if i == c)

    before, after = seen[3]
    n = collections.Counter(r.source for r in before)
    weight = {s: mixing.WEIGHTS.get(s, 1.0) for s in n}
    counts = collections.Counter(r.doc_id for r in after)
    for r in before:
        rate = weight[r.source] * len(before) / sum(weight.values()) / n[r.source]
        u = (int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, term = 0, math.exp(-rate)
        total = term
        while total < u:
            k += 1
            term *= rate / k
            total += term
        assert counts.get(r.doc_id, 0) == k

    before, after = seen[4]
    assert collections.Counter((r.doc_id) for r in after for _ in range(r.n_tokens)) == collections.Counter(r.doc_id for r in before for _ in range(len(WORD.findall(r.text)) + 1))
    rows = collections.defaultdict(dict)
    for r in after:
        rows[r.row][r.chunk] = (r.doc_id, r.text)
    assert collections.Counter((p[0][0], "".join(p[c][1] for c in sorted(p))) for p in rows.values()) == collections.Counter((r.doc_id, r.text) for r in before)


def test_awkward_documents(spark, tmp_path):
    """Nulls, empties, repeated rows and ids, long texts, columns of helpers' names, and an empty table, through all stages."""
    import pyspark.sql.functions as F

    from tests.llm.test_operators import AWKWARD, DOCS

    labels = spark.createDataFrame([(1, 1, 0), (None, None, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumns({c: F.lit("mine") for c in ("__row", "row", "chunk", "rate", "kept", "label")})
    for some, name in ((docs, "odd"), (docs.limit(0), "none")):
        where = str(tmp_path / name)
        some.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        rows = spark.read.parquet(f"{where}/documents.parquet")
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            before = rows
            rows = corpus_pipeline.stored(run(spark, rows, where))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert rows.columns == docs.columns, stage
            if k < 2:
                assert rows.count() == before.count(), stage
        assert corpus_pipeline.run(spark, where).count() == rows.count() and (rows.count() > 0) == (name == "odd")
        whole = collections.defaultdict(dict)
        for r in rows.collect():
            whole[r.row][r.chunk] = r.text
        texts = {r.text or "" for r in before.collect()}
        assert all("".join(p[c] for c in sorted(p)) in texts for p in whole.values())
