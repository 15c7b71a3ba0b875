"""Exact line deduplication across documents.

Lines are exploded, normalised and hashed; distinct documents are counted per hash; lines of hashes over the threshold
go (but in one document), and the rest are put together again by position. Every step is a DataFrame operation.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, doc_key, in_row, maybe_in, pack_row, stored, unpack_row


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WS_CHARS))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Input rows as ``__row`` with ``__drop`` (0-based positions of the lines that go, null if none).

    * A null text counts as one empty line; lines are split at ``\\n`` only.
    * A key is the trimmed line with A-Z lower-cased; only keys of ``min_chars`` code points take part. Keys are compared
      by two independent 64-bit hashes.
    * Keys in at least ``min_docs`` distinct documents lose all lines but those of the largest id. A null id is one
      document, smaller than all others; rows that repeat an id count as one document and are each put together from
      their own text. An empty table stays empty; further columns of any name stay.
    * The counts are map-side combined on (key, id) and then on key, so a line held by a third of all documents costs one
      row per task; the join back to the lines can be split by AQE, as nothing above it needs a key's rows together.
    * What meets the documents again is only (id, version, positions). A bitmap of fixed size tells the documents that lose
      lines from most others, which stay where they are; only the former move, each with its text once.
    """
    rows = pack_row(docs).withColumn("__id", doc_key(in_row(id_col))).withColumn("__version", F.xxhash64(_text(text_col)))
    lines = (
        rows.select("__id", "__version", F.posexplode(F.split(_text(text_col), "\n", -1)).alias("__pos", "__line"))
        .withColumn("__line", _trimmed(F.col("__line")))
        .filter(F.length("__line") >= min_chars)
        .withColumn("__line", ascii_lower(F.col("__line")))
        .select("__id", "__version", "__pos", F.xxhash64("__line").alias("__h1"), F.xxhash64(F.lit(7), "__line").alias("__h2"))
    )
    common = stored(
        lines.groupBy("__h1", "__h2", "__id")
        .agg(F.lit(1).alias("__one"))
        .groupBy("__h1", "__h2")
        .agg(F.count("__one").alias("__n"), F.max("__id").alias("__keep"))
        .filter(F.col("__n") >= min_docs)
    )
    gone = stored(
        lines.join(common, ["__h1", "__h2"])
        .filter(F.col("__id") != F.col("__keep"))
        .groupBy("__id", "__version")
        .agg(F.collect_set("__pos").alias("__drop"))
    )
    key = F.xxhash64("__id", "__version")
    told = maybe_in(rows, key, gone, key)
    whole = told.filter(~F.col("__maybe")).select("__row", F.lit(None).cast("array<int>").alias("__drop"))
    touched = told.filter("__maybe").join(gone, ["__id", "__version"], "left").select("__row", "__drop")
    return whole.unionByName(touched)


def _text(text_col: str) -> Column:
    return F.coalesce(in_row(text_col), F.lit(""))


def _kept_text(text_col: str) -> Column:
    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")

    joined = F.element_at(F.transform(F.array(F.split(_text(text_col), "\n", -1)), kept), 1)
    return F.when(F.col("__drop").isNull(), _text(text_col)).otherwise(joined)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``; rows and other columns stay. A null text stays null."""
    report = line_report(docs, id_col=id_col, text_col=text_col, **rules)
    text = F.when(in_row(text_col).isNull(), in_row(text_col)).otherwise(_kept_text(text_col))
    return unpack_row(report, docs.columns, **{text_col: text})


def line_dedup_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256. Only id and text are read.

    A null or empty text has one line, none dropped, and the digest of the empty text; null ids and repeated rows stay.
    """
    report = line_report(docs.select(f"`{id_col}`", f"`{text_col}`"), id_col=id_col, text_col=text_col, **rules)
    return report.select(
        in_row(id_col).cast("long").alias("doc_id"),
        (F.octet_length(_text(text_col)) - F.octet_length(F.replace(_text(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
        F.sha2(_kept_text(text_col).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keep AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
