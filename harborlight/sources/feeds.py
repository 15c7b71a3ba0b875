"""Vulnerability feeds: CVE records, the known-exploited catalog and exploitation scores, read defensively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CVE_PATTERN, printable

MAX_DESCRIPTION, MAX_REFERENCES, MAX_CRITERIA, MAX_KEV, MAX_EPSS = 4_000, 50, 500, 100_000, 1_000_000
# Metric blocks, newest first, the severities known and, in the readers below, the wording of refusals.
METRICS = {"cvssMetricV31": "3.1", "cvssMetricV30": "3.0", "cvssMetricV2": "2.0"}
SEVERITIES = ["none", "low", "medium", "high", "critical"]


def text_field(value: Column, limit: int) -> Column:
    return F.nullif(F.left(F.btrim(printable(value)), F.lit(limit)), F.lit(""))


def _string(v: Column, path: str) -> Column:
    """A string at a path of a variant; null for other kinds."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, path, "string"))


def read_cves(documents: DataFrame, max_criteria: int | None = MAX_CRITERIA, max_references: int | None = MAX_REFERENCES) -> tuple[DataFrame, DataFrame]:
    """CVE records and refusals of feed pages (document_id, json).

    A page must be an object with a list ``vulnerabilities`` (or say by ``totalResults`` that it has none); else the whole page is
    refused. An entry without a usable id is refused alone. Of one record ``max_criteria`` and ``max_references`` are read (None:
    all); a record that has more is named among the refusals too, as a criterion not read may be a vulnerability not seen.
    """
    bounds = {"cpe_matches": (max_criteria, "criteria"), "references": (max_references, "references")}
    doc = documents.select("document_id", F.try_parse_json("json").alias("v"))
    shape = F.schema_of_variant(F.try_variant_get("v", "$.vulnerabilities", "variant"))
    empty = F.try_variant_get("v", "$.vulnerabilities", "variant").isNull() & F.try_variant_get("v", "$.totalResults", "variant").isNotNull()
    reason = (
        F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "not a JSON object")
        .when(empty, F.lit(None).cast("string"))
        .when(shape.isNull(), "no 'vulnerabilities' field")
        .when(~shape.startswith("ARRAY"), "'vulnerabilities' is not a list")
    )
    doc = doc.withColumn("reason", reason)
    entries = doc.filter("reason is null").select("document_id", F.posexplode(F.try_variant_get("v", "$.vulnerabilities", "array<variant>")).alias("pos", "e"))
    cve = entries.withColumn("id", text_field(_string(F.col("e"), "$.cve.id"), 32))
    bad = F.when(~F.schema_of_variant("e").startswith("OBJECT"), "entry is not an object").when(~F.coalesce(F.schema_of_variant(F.try_variant_get("e", "$.cve", "variant")).startswith("OBJECT"), F.lit(False)), "entry has no 'cve' object").when(
        ~F.coalesce(F.upper("id").startswith("CVE-"), F.lit(False)), "missing or malformed CVE id"
    )
    cve = cve.withColumn("reason", bad)
    e = F.col("e")
    listed = lambda path: F.coalesce(F.try_variant_get(e, path, "array<variant>"), F.array().cast("array<variant>"))
    described = F.filter(F.transform(listed("$.cve.descriptions"), lambda d: F.struct(_string(d, "$.lang").alias("lang"), text_field(_string(d, "$.value"), MAX_DESCRIPTION).alias("text"))), lambda d: d["text"].isNotNull())
    description = F.coalesce(F.try_element_at(F.filter(described, lambda d: d["lang"] == "en"), F.lit(1))["text"], F.try_element_at(described, F.lit(1))["text"], F.lit(""))
    score = None
    for key, version in METRICS.items():
        at = f"$.cve.metrics.{key}[0]"
        base = F.try_variant_get(e, f"{at}.cvssData.baseScore", "double")
        numeric = F.schema_of_variant(F.try_variant_get(e, f"{at}.cvssData.baseScore", "variant")).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
        severity = F.lower(F.btrim(F.coalesce(_string(e, f"{at}.cvssData.baseSeverity"), _string(e, f"{at}.baseSeverity"))))
        one = F.struct(base.alias("score"), text_field(_string(e, f"{at}.cvssData.vectorString"), 200).alias("vector"), F.lit(version).alias("version"), F.when(severity.isin(SEVERITIES), severity).alias("severity"))
        ok = F.coalesce(numeric & base.between(0, 10), F.lit(False))
        score = F.when(ok, one) if score is None else score.when(ok, one)
    nodes = F.flatten(F.transform(listed("$.cve.configurations"), lambda c: F.coalesce(F.try_variant_get(c, "$.nodes", "array<variant>"), F.array().cast("array<variant>"))))
    raw = F.flatten(F.transform(nodes, lambda n: F.coalesce(F.try_variant_get(n, "$.cpeMatch", "array<variant>"), F.array().cast("array<variant>"))))
    bound = lambda m, k: text_field(_string(m, f"$.{k}"), 100)
    criteria = F.transform(
        raw,
        lambda m: F.struct(
            text_field(_string(m, "$.criteria"), 500).alias("criteria"),
            bound(m, "versionStartIncluding").alias("start_including"),
            bound(m, "versionStartExcluding").alias("start_excluding"),
            bound(m, "versionEndIncluding").alias("end_including"),
            bound(m, "versionEndExcluding").alias("end_excluding"),
            F.coalesce(F.try_variant_get(m, "$.vulnerable", "boolean"), F.lit(True)).alias("vulnerable"),
        ),
    )
    named = F.filter(criteria, lambda c: F.coalesce(c["criteria"].startswith("cpe:"), F.lit(False)))
    bare = lambda c: F.struct(*[c[k].alias(k) for k in ("criteria", "start_including", "start_excluding", "end_including", "end_excluding")])
    keys = F.transform(named, bare)
    first = F.filter(F.transform(named, lambda c, i: F.struct(c.alias("c"), (F.array_position(keys, bare(c)) == i + 1).alias("new"))), lambda x: x["new"])
    refs = F.filter(F.transform(listed("$.cve.references"), lambda r: text_field(_string(r, "$.url"), 500)), lambda u: F.coalesce(u.rlike("^https?://"), F.lit(False)))
    good = cve.filter("reason is null").withColumn("s", score)
    out = good.select(
        "document_id",
        "pos",
        F.upper("id").alias("cve_id"),
        description.alias("description"),
        F.try_to_timestamp(_string(e, "$.cve.published")).alias("published_at"),
        F.try_to_timestamp(_string(e, "$.cve.lastModified")).alias("last_modified_at"),
        F.col("s.score").alias("cvss_score"),
        F.col("s.vector").alias("cvss_vector"),
        F.col("s.version").alias("cvss_version"),
        F.col("s.severity").alias("severity"),
        F.transform(first, lambda x: x["c"]).alias("cpe_matches"),
        refs.alias("references"),
    )
    # what the bounds cut is named among the refusals
    cut = out.select("document_id", "pos", F.col("cve_id").alias("identifier"), *[F.size(c).alias(c) for c in bounds])
    reasons = F.filter(F.array(*[F.when(F.col(c) > most, F.concat(F.lit(f"{most} of "), F.col(c).cast("string"), F.lit(f" {what} read"))) for c, (most, what) in bounds.items() if most is not None]), lambda r: r.isNotNull())
    cut = cut.select("document_id", "pos", "identifier", F.explode(reasons.cast("array<string>")).alias("reason"))
    for c, (most, _) in bounds.items():
        out = out if most is None else out.withColumn(c, F.slice(c, 1, most))
    pages = doc.filter("reason is not null").select("document_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("identifier"), "reason")
    return out, pages.unionByName(cve.filter("reason is not null").select("document_id", "pos", F.col("id").alias("identifier"), "reason")).unionByName(cut)


def criteria_of(cves: DataFrame) -> DataFrame:
    """One row per CVE and criterion, as correlation takes them."""
    return cves.select("cve_id", F.posexplode("cpe_matches").alias("pos", "c")).select("cve_id", "pos", "c.*")


def read_kev(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and refusals of the known-exploited catalog (document_id, json): the first entry of a CVE counts.

    A document of another shape or over the size bound is refused whole, as an empty catalog would clear every listing.
    """
    doc = documents.select("document_id", F.try_parse_json("json").alias("v")).withColumn("list", F.try_variant_get("v", "$.vulnerabilities", "array<variant>"))
    reason = F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "not a JSON object").when(F.col("list").isNull(), "no 'vulnerabilities' list").when(F.size("list") > MAX_KEV, f"more than {MAX_KEV} entries")
    doc = doc.withColumn("reason", reason)
    e = doc.filter("reason is null").select("document_id", F.posexplode("list").alias("pos", "e")).withColumn("cve_id", F.upper(text_field(_string(F.col("e"), "$.cveID"), 32)))
    bad = F.when(~F.schema_of_variant("e").startswith("OBJECT"), "entry is not an object").when(~F.coalesce(F.col("cve_id").rlike(CVE_PATTERN), F.lit(False)), "missing or malformed CVE id")
    e = e.withColumn("reason", bad)
    field = lambda k, n=300: text_field(_string(F.col("e"), f"$.{k}"), n)
    day = lambda k: F.try_to_timestamp(F.btrim(_string(F.col("e"), f"$.{k}")), F.lit("yyyy-MM-dd"))
    flag = F.lower(F.btrim(_string(F.col("e"), "$.knownRansomwareCampaignUse")))
    rows = e.filter("reason is null").select(
        "document_id",
        "pos",
        "cve_id",
        field("vendorProject").alias("vendor"),
        field("product").alias("product"),
        field("vulnerabilityName").alias("name"),
        day("dateAdded").alias("date_added"),
        day("dueDate").alias("due_date"),
        F.when(flag == "known", True).when(flag == "unknown", False).alias("known_ransomware"),
    )
    first = F.row_number().over(Window.partitionBy("document_id", "cve_id").orderBy("pos"))
    good = rows.withColumn("n", first).filter("n = 1").drop("n")
    pages = doc.filter("reason is not null").select("document_id", F.lit(None).cast("int").alias("pos"), "reason")
    return good, pages.unionByName(e.filter("reason is not null").select("document_id", "pos", "reason"))


def probability(text: Column) -> Column:
    """A number from 0 to 1; NaN and infinities are none."""
    n = F.btrim(text).try_cast("double")
    return F.when(~F.isnan(n) & n.between(0, 1), n)


def read_epss(documents: DataFrame, max_rows: int | None = MAX_EPSS) -> tuple[DataFrame, DataFrame]:
    """Scores and refusals of snapshots (document_id, text): ``#`` header with model and date, then cve, epss, percentile.

    A snapshot of more than ``max_rows`` (None: no bound) is refused whole.
    """
    split = documents.select("document_id", F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n").alias("all"))
    data = F.filter("all", lambda x: (F.btrim(x) != "") & ~x.startswith("#"))
    doc = split.select("document_id", F.element_at("all", 1).alias("head"), data.alias("data"))
    doc = doc.withColumn("columns", F.transform(F.split(F.coalesce(F.try_element_at("data", F.lit(1)), F.lit("")), ","), F.btrim))
    reason = F.when(~F.array_contains("columns", "cve"), "no 'cve' column").when(F.size("data") < 2, "empty snapshot")
    reason = reason if max_rows is None else reason.when(F.size("data") - 1 > max_rows, f"more than {max_rows} rows")
    doc = doc.withColumn("reason", reason)
    header = lambda k: F.when(F.col("head").startswith("#"), F.nullif(F.btrim(F.regexp_extract("head", rf"(?:^#|,){k}:([^,]*)", 1)), F.lit("")))
    rows = doc.filter("reason is null").select("document_id", "columns", F.left(header("model_version"), F.lit(50)).alias("model_version"), F.try_to_timestamp(header("score_date")).alias("scored_at"), F.posexplode(F.slice("data", 2, 2**31 - 2)).alias("pos", "line"))
    cells = F.split("line", ",")
    cell = lambda name: F.try_element_at(cells, F.array_position("columns", name).cast("int"))
    has = lambda name: F.array_contains("columns", name)
    rows = rows.select("document_id", "pos", "model_version", "scored_at", F.upper(F.btrim(cell("cve"))).alias("cve_id"), F.when(has("epss"), probability(cell("epss"))).alias("score"), F.when(has("percentile"), probability(F.when(has("percentile"), cell("percentile")))).alias("percentile"))
    rows = rows.withColumn("reason", F.when(~F.coalesce(F.col("cve_id").rlike(CVE_PATTERN), F.lit(False)), "malformed CVE id").when(F.col("score").isNull(), "score is not a probability between 0 and 1"))
    good = rows.filter("reason is null").select("document_id", "cve_id", "score", "percentile", "model_version", "scored_at")
    pages = doc.filter("reason is not null").select("document_id", F.lit(None).cast("int").alias("pos"), "reason")
    return good, pages.unionByName(rows.filter("reason is not null").select("document_id", "pos", "reason"))


def retry_decision(status: Column, attempt: Column, max_retries: int = 3) -> Column:
    """ok, retry or fail for a feed's HTTP status."""
    # Statuses that mean "ask again later".
    later = status.isin(429, 500, 502, 503, 504)
    return F.when(status.between(200, 299), "ok").when(later & (attempt <= max_retries), "retry").otherwise("fail")


def epss_files(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots (document_id, text) for :func:`read_epss` from files, gzipped (by their names) or not."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document_id"), F.col("value").alias("text"))
