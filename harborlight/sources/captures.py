"""Passive captures: ARP tables, DHCP leases and mDNS listings.

A capture is a row (capture_id, kind, observed_at, text). Each reader gives a table of sightings and one of refused lines, so
every significant line is accounted for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import address_text
from ..functions.text import clean_hostname, passive_mac

# Confidence by source; line patterns; and, in the readers below, the wording of refusals.
CONFIDENCE = {"arp": 0.9, "dhcp": 0.8, "mdns": 0.6}
_NEIGH = r"^(\S+)\s+dev\s+(\S+)\s+lladdr\s+(\S+)\s+([A-Z]+)\s*$"
_BSD = r"^\S*\s*\(([^)]+)\)\s+at\s+([0-9a-fA-F:]+)\s+on\s+(\S+)"
RECORD = ["capture_id", "target", "source", "source_type", "collection_method", "confidence", "observed_at", "mac", "hostname", "attributes"]


def significant_lines(captures: DataFrame) -> DataFrame:
    """(capture_id, observed_at, lineno, line) of lines that are neither blank nor comments; numbers start at 1."""
    split = captures.select("capture_id", "observed_at", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("pos", "raw"))
    return split.select("capture_id", "observed_at", (F.col("pos") + 1).alias("lineno"), F.btrim(F.col("raw"), F.lit(" \t")).alias("line")).filter("line <> '' and not startswith(line, '#')")


def _split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    judged = rows.withColumn("reason", reason)
    return judged.filter("reason is null"), judged.filter("reason is not null").select("capture_id", "lineno", "reason")


def _attributes(**values: Column) -> Column:
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.map_from_entries(entries)


def _records(rows: DataFrame, source: str, source_type: str, method: str) -> DataFrame:
    fixed = {"source": source, "source_type": source_type, "collection_method": method, "confidence": CONFIDENCE[source]}
    return rows.select(*[F.lit(fixed[c]).alias(c) if c in fixed else F.col(c) for c in RECORD])


def read_arp(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ip neigh`` and ``arp -an`` lines."""
    rows = significant_lines(captures)
    neigh = F.col("line").rlike(_NEIGH)
    pick = lambda i, j: F.when(neigh, F.regexp_extract("line", _NEIGH, i)).otherwise(F.regexp_extract("line", _BSD, j))
    rows = rows.withColumn("target", address_text(pick(1, 1))).withColumn("dev", pick(2, 3)).withColumn("mac", passive_mac(pick(3, 2)))
    unresolved = neigh & F.regexp_extract("line", _NEIGH, 4).isin("INCOMPLETE", "FAILED")
    reason = (
        F.when(~neigh & ~F.col("line").rlike(_BSD), "unrecognised ARP entry format")
        .when(unresolved, "unresolved ARP entry (no confirmed MAC)")
        .when(F.col("target").isNull(), "address does not parse as an IP")
        .when(F.col("mac").isNull(), "hardware address is not a MAC")
    )
    good, bad = _split(rows, reason)
    good = good.withColumn("hostname", F.lit(None).cast("string")).withColumn("attributes", _attributes(interface=F.col("dev")))
    return _records(good, "arp", "passive", "arp_table"), bad


def read_leases(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ISC ``dhcpd.leases``: active leases with a start, dated by it. Blocks are cut at ``lease`` headers."""
    lines = significant_lines(captures).groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("lineno", "line"))).alias("ls"))
    starts = F.filter("ls", lambda x: x["line"].startswith("lease ") & x["line"].endswith("{"))
    blocks = lines.select("capture_id", "ls", F.explode(F.transform(starts, lambda s: s["lineno"])).alias("lineno"))
    ends = F.coalesce(F.array_min(F.transform(F.filter("ls", lambda x: (x["lineno"] > F.col("lineno")) & (x["line"].startswith("lease ") & x["line"].endswith("{"))), lambda x: x["lineno"])), F.lit(2**31 - 1))
    blocks = blocks.withColumn("end", ends)
    inside = F.transform(F.filter("ls", lambda x: (x["lineno"] >= F.col("lineno")) & (x["lineno"] < F.col("end"))), lambda x: x["line"])
    blocks = blocks.select("capture_id", "lineno", inside.alias("body"))
    closed_at = F.array_position("body", "}")
    blocks = blocks.withColumn("closed", closed_at > 0).withColumn("body", F.when(closed_at > 0, F.slice("body", F.lit(1), closed_at.cast("int"))).otherwise(F.col("body")))
    value = lambda prefix: F.btrim(F.substring(F.rtrim(F.element_at(F.filter("body", lambda x: x.startswith(prefix)), -1), F.lit(";")), len(prefix) + 1, 10_000))
    last = lambda prefix: F.when(F.exists("body", lambda x: x.startswith(prefix)), value(prefix))
    stamp = lambda key: F.nullif(F.regexp_extract(last(f"{key} "), r"^\d\s+([\d/]+\s[\d:]+)$", 1), F.lit(""))
    rows = blocks.select(
        "capture_id",
        "lineno",
        "closed",
        address_text(F.regexp_extract(F.element_at("body", 1), r"^lease\s+(.*?)\s*\{$", 1)).alias("target"),
        last("binding state ").alias("state"),
        F.try_to_timestamp(stamp("starts"), F.lit("yyyy/MM/dd HH:mm:ss")).alias("observed_at"),
        stamp("ends").alias("ends"),
        passive_mac(last("hardware ethernet ")).alias("mac"),
        clean_hostname(last("client-hostname ")).alias("hostname"),
    )
    reason = (
        F.when(F.col("target").isNull(), "lease address does not parse as an IP")
        .when(~F.col("closed"), "unterminated lease block")
        .when((F.coalesce("state", F.lit("")) != "active") | F.col("observed_at").isNull(), "lease is not active or has no start")
    )
    good, bad = _split(rows, reason)
    return _records(good.withColumn("attributes", _attributes(binding_state=F.lit("active"), lease_ends=F.col("ends"))), "dhcp", "authoritative", "dhcp_lease_file"), bad


def read_mdns(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``avahi-browse -p``: resolved records."""
    rows = significant_lines(captures).withColumn("f", F.split("line", ";"))
    at = lambda i: F.try_element_at("f", F.lit(i))
    rows = rows.withColumn("target", address_text(at(8))).withColumn("mac", F.lit(None).cast("string")).withColumn("hostname", clean_hostname(at(7)))
    reason = (
        F.when(at(1) != "=", "not a resolved mDNS record")
        .when(F.size("f") < 9, "resolved mDNS record has too few fields")
        .when(F.col("target").isNull(), "address does not parse as an IP")
    )
    good, bad = _split(rows, reason)
    about = _attributes(interface=at(2), protocol=at(3), service_name=F.replace(at(4), F.lit("\\032"), F.lit(" ")), service_type=at(5), port=at(9))
    return _records(good.withColumn("attributes", about), "mdns", "passive", "mdns_browse"), bad


READERS = {"arp": read_arp, "dhcp": read_leases, "mdns": read_mdns}


def read_captures(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All captures by their ``kind``."""
    records, refused = [], []
    for kind, reader in READERS.items():
        good, bad = reader(captures.filter(F.col("kind") == kind))
        records.append(good)
        refused.append(bad)
    out = [records[0], refused[0]]
    for i, parts in enumerate((records, refused)):
        for p in parts[1:]:
            out[i] = out[i].unionByName(p)
    return out[0], out[1]


def anchors_of(records: DataFrame, id_col: str) -> DataFrame:
    """(id, seq, kind, value, confidence) of each sighting's MAC, hostname and address, strongest first."""
    three = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(k).alias("kind"), F.col(c).alias("value")) for i, (k, c) in enumerate((("mac", "mac"), ("hostname", "hostname"), ("ip", "target")))])
    return records.select(id_col, "confidence", F.explode(F.filter(three, lambda a: a["value"].isNotNull())).alias("a")).select(id_col, "a.seq", "a.kind", "a.value", "confidence")


def observations_of(records: DataFrame) -> DataFrame:
    """Sightings as observations with a JSON payload; attributes are prefixed ``attr_``."""
    extra = F.transform_keys("attributes", lambda k, v: F.concat(F.lit("attr_"), k))
    base = F.create_map(F.lit("ip"), F.col("target"), F.lit("mac"), F.col("mac"), F.lit("hostname"), F.col("hostname"))
    return records.select(
        F.lit("passive_sighting").alias("observation_type"),
        F.to_json(F.map_concat(base, extra), {"ignoreNullFields": "false"}).alias("payload"),
        "source",
        "source_type",
        F.col("target").alias("source_identifier"),
        "collection_method",
        "confidence",
        "observed_at",
    )
