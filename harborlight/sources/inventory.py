"""Inventory exports: rows of text cells into managed records, every other row with the reason it was refused."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import defanged, printable

MAX_CELL, MAX_ROWS = 500, 200_000


@dataclass(frozen=True)
class Mapping:
    """Which column of the file holds what."""

    external_id: str
    hostname: str | None = None
    serial: str | None = None
    mac: str | None = None
    ip: str | None = None
    owner: str | None = None
    extras: dict[str, str] = field(default_factory=dict)


def read_csv(spark: SparkSession, path: str, mapping: Mapping) -> DataFrame:
    """The file's cells as text, with ``row_number`` (from 2: the header is row 1) in file order.

    Rows are numbered by one task: an export is a file of at most 200 000 rows, and more are refused.
    """
    rows = spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=True, encoding="UTF-8", enforceSchema=False)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    wanted = [c for c in (mapping.external_id, mapping.hostname, mapping.serial, mapping.mac, mapping.ip, mapping.owner, *mapping.extras.values()) if c]
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"columns not in the file: {', '.join(missing)}")
    if rows.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows")
    order = F.monotonically_increasing_id()
    return rows.withColumn("__o", order).withColumn("row_number", F.row_number().over(Window.orderBy("__o")) + 1).drop("__o")


_CELL = re.compile(r"([A-Z]+)")


def _sheet(data: bytes) -> list[list[str]]:
    """The first sheet of a workbook as text; formulas stay text (``=...``), so that they are defanged, never run."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n) for n in z.namelist() if n == "xl/sharedStrings.xml" or re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)}
    if any(b"<!DOCTYPE" in x or b"<!ENTITY" in x for x in parts.values()):
        raise ValueError("document types are refused")
    sheet = min((n for n in parts if n.startswith("xl/worksheets")), key=lambda n: int(re.search(r"\d+", n)[0]), default=None)
    if sheet is None:
        raise ValueError("the workbook has no sheet")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{ns}t"))
    shared = [text(e) for e in ElementTree.fromstring(parts["xl/sharedStrings.xml"]).iter(f"{ns}si")] if "xl/sharedStrings.xml" in parts else []
    rows = []
    for row in ElementTree.fromstring(parts[sheet]).iter(f"{ns}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{ns}c"):
            at = 0
            for ch in _CELL.match(c.get("r", "A"))[1]:
                at = at * 26 + ord(ch) - 64
            formula, value = c.find(f"{ns}f"), c.find(f"{ns}v")
            raw = f"={formula.text or ''}" if formula is not None else text(c) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
            cells[at] = shared[int(raw)] if c.get("t") == "s" and formula is None and raw else raw
        rows.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
        if len(rows) > MAX_ROWS + 1:
            raise ValueError(f"more than {MAX_ROWS} rows")
    return rows


def read_xlsx(spark: SparkSession, path: str, mapping: Mapping) -> DataFrame:
    """As :func:`read_csv`, for the first sheet of a workbook. The file is read by Spark and unpacked in one task (an export is
    small: its rows are bounded)."""
    (data,) = spark.read.format("binaryFile").load(path).select("content").first()
    head, *rows = _sheet(bytes(data)) or [[]]
    names = [h.strip() for h in head]
    wanted = [c for c in (mapping.external_id, mapping.hostname, mapping.serial, mapping.mac, mapping.ip, mapping.owner, *mapping.extras.values()) if c]
    if missing := [c for c in wanted if c not in names]:
        raise ValueError(f"columns not in the file: {', '.join(missing)}")
    cells = [(n, *[(r[i] if i < len(r) else "") for i in range(len(names))]) for n, r in enumerate(rows, 2)]
    return spark.createDataFrame(cells, T.StructType([T.StructField("row_number", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in names]]))


def clean_cell(raw: Column) -> Column:
    return defanged(F.left(F.btrim(printable(F.coalesce(raw, F.lit("")))), F.lit(MAX_CELL)))


def normalized_hostname(v: Column) -> Column:
    t = F.lower(F.rtrim(v, F.lit(".")))
    return F.when(t.rlike(r"^[a-z0-9]([a-z0-9._-]{0,252}[a-z0-9])?$"), t)


def normalized_mac(v: Column) -> Column:
    """Colon form of any common writing, or of twelve bare digits."""
    c = F.replace(F.translate(F.lower(F.btrim(v)), "-.", "::"), F.lit(" "), F.lit(""))
    parts = F.split(c, ":")
    six = (F.size(parts) == 6) & F.forall(parts, lambda p: F.length(p).between(1, 2))
    form = F.when(six, F.array_join(F.transform(parts, lambda p: F.lpad(p, 2, "0")), ":")).when(F.length(c) == 12, F.regexp_replace(c, "(..)(?=.)", "$1:"))
    return F.when(form.rlike("^[0-9a-f]{2}(:[0-9a-f]{2}){5}$"), form)


def normalized_serial(v: Column) -> Column:
    t = F.btrim(v)
    return F.when(t.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,63}$"), t)


def normalized_ip(v: Column) -> Column:
    t = F.btrim(v)
    ok = t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(F.split(t, r"\."), lambda o: F.coalesce(o.try_cast("int") <= 255, F.lit(False)))
    return F.when(ok, t)


_NORMAL = {"hostname": normalized_hostname, "serial": normalized_serial, "mac": normalized_mac, "ip": normalized_ip, "owner": lambda v: v}


def managed_records(rows: DataFrame, mapping: Mapping, source: str = "cmdb") -> tuple[DataFrame, DataFrame]:
    """Records and refusals (row_number, reason, column) of rows with ``row_number`` and text cells.

    Checks in order: blank, an oversized cell, no external id, an id an earlier record has, no identity. A row without identity
    does not claim its id. Every row is in exactly one of the two tables.
    """
    cells = [c for c in rows.columns if c != "row_number"]
    clean = rows.select("row_number", *[clean_cell(F.col(f"`{c}`")).alias(c) for c in cells])
    filled = F.exists(F.array(*[F.col(f"`{c}`") for c in cells]), lambda v: v != "")
    oversized = F.coalesce(*[F.when(F.length(f"`{c}`") >= MAX_CELL, F.lit(c)) for c in cells])
    mapped = {f: getattr(mapping, f) for f in _NORMAL}
    value = {f: _NORMAL[f](F.nullif(F.btrim(f"`{c}`"), F.lit(""))) if c else F.lit(None).cast("string") for f, c in mapped.items()}
    extras = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.nullif(F.col(f"`{c}`"), F.lit("")).alias("v")) for n, c in mapping.extras.items()]), lambda e: e["v"].isNotNull())) if mapping.extras else F.create_map().cast("map<string,string>")
    out = clean.select("row_number", filled.alias("__filled"), oversized.alias("__big"), F.nullif(F.btrim(f"`{mapping.external_id}`"), F.lit("")).alias("external_id"), *[v.alias(f) for f, v in value.items()], extras.alias("attributes"))
    has_identity = F.coalesce("serial", "mac", "hostname", "ip").isNotNull()
    claims = F.col("__filled") & F.col("__big").isNull() & F.col("external_id").isNotNull()
    owner = F.min(F.when(claims & has_identity, F.col("row_number"))).over(Window.partitionBy("external_id"))
    out = out.withColumn("__owner", owner)
    reason = (
        F.when(~F.col("__filled"), "blank")
        .when(F.col("__big").isNotNull(), "oversized")
        .when(F.col("external_id").isNull(), "no_external_id")
        .when(F.col("row_number") > F.col("__owner"), "duplicate_external_id")
        .when(~has_identity, "no_identity")
    )
    out = out.withColumn("reason", reason)
    column = F.when(F.col("reason") == "oversized", F.col("__big")).when(F.col("reason") == "no_external_id", F.lit(mapping.external_id))
    good = out.filter("reason is null").select(F.lit(source).alias("source"), "external_id", *value, "attributes", "row_number")
    return good, out.filter("reason is not null").select("row_number", "reason", column.alias("column"))
