"""Scan reports (XML) and package lists read from devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import printable

# Confidences and caps.
PORT_CONFIDENCE, DEFAULT_SERVICE_CONFIDENCE, PACKAGE_CONFIDENCE = 0.9, 0.3, 0.95
MAX_FIELD, MAX_LINES, MAX_COMPONENTS = 200, 20_000, 5_000
_SCHEMA = """
host array<struct<_starttime:string,_endtime:string,
  status:struct<_state:string>,
  address:array<struct<_addr:string,_addrtype:string,_vendor:string>>,
  hostnames:struct<hostname:array<struct<_name:string>>>,
  ports:struct<port:array<struct<_protocol:string,_portid:string,state:struct<_state:string>,
    service:struct<_name:string,_product:string,_version:string,_conf:string>>>>>>,
runstats struct<finished:struct<_time:string>>
"""


def clean(text: Column) -> Column:
    return F.nullif(F.left(F.btrim(printable(text)), F.lit(MAX_FIELD)), F.lit(""))


def _epoch(text: Column) -> Column:
    n = text.try_cast("bigint")
    return F.when(n.between(1, 253_402_300_799), F.timestamp_seconds(n))


def service_confidence(conf: Column) -> Column:
    n = conf.try_cast("int")
    return F.when(n.between(1, 10), F.round(n / 10, 2)).otherwise(F.lit(DEFAULT_SERVICE_CONFIDENCE))


def read_scans(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts and refusals of scan reports (scan_id, xml).

    A host row has host_up, mac, vendor, hostname, observed_at and its open ports. A run that reached no host is a host row that
    is not up; text that is no scan report (empty, malformed, another root, or with a document type, which could hold
    entities) is refused, never read as "no ports".
    """
    t = F.btrim(F.coalesce("xml", F.lit("")), F.lit(" \t\r\n"))
    rows = scans.select("scan_id", t.alias("xml"))
    root = F.regexp_extract("xml", r"(?s)^(?:<\?xml[^>]*\?>)?\s*(?:<!--.*?-->\s*|<!DOCTYPE\s+nmaprun\s*>\s*|<\?[^>]*\?>\s*)*<([A-Za-z][\w:-]*)", 1)
    reason = (
        F.when(F.col("xml") == "", "no XML output")
        .when(F.contains("xml", F.lit("<!ENTITY")) | F.col("xml").rlike(r"<!DOCTYPE[^>]*\["), "entity declarations are refused")
        .when(root == "", "XML could not be parsed")
        .when(root != "nmaprun", F.concat(F.lit("unexpected root element: "), root))
        .when(~F.col("xml").rlike(r"(?s)</nmaprun>\s*$|<nmaprun[^>]*/>\s*$"), "XML could not be parsed")
    )
    judged = rows.withColumn("reason", reason)
    good = judged.filter("reason is null").withColumn("x", F.from_xml("xml", _SCHEMA.replace("\n", " ")))
    h = F.try_element_at("x.host", F.lit(1))
    mac = F.try_element_at(F.filter(h["address"], lambda a: a["_addrtype"] == "mac"), F.lit(1))
    names = F.filter(F.transform(h["hostnames"]["hostname"], lambda n: clean(n["_name"])), lambda n: n.isNotNull())
    open_ = F.filter(h["ports"]["port"], lambda p: (p["state"]["_state"] == "open") & p["_portid"].try_cast("int").between(1, 65535) & p["_protocol"].isin("tcp", "udp"))
    ports = F.transform(
        open_,
        lambda p: F.struct(
            p["_portid"].try_cast("int").alias("port"),
            p["_protocol"].alias("protocol"),
            clean(p["service"]["_name"]).alias("service"),
            clean(p["service"]["_product"]).alias("product"),
            clean(p["service"]["_version"]).alias("version"),
            service_confidence(p["service"]["_conf"]).alias("confidence"),
        ),
    )
    hosts = good.select(
        "scan_id",
        F.coalesce(h["status"]["_state"] == "up", F.lit(False)).alias("host_up"),
        F.lower(clean(mac["_addr"])).alias("mac"),
        clean(mac["_vendor"]).alias("vendor"),
        F.try_element_at(names, F.lit(1)).alias("hostname"),
        F.coalesce(_epoch(h["_endtime"]), _epoch(h["_starttime"]), _epoch(F.col("x.runstats.finished._time"))).alias("observed_at"),
        F.coalesce(ports, F.array().cast("array<struct<port:int,protocol:string,service:string,product:string,version:string,confidence:double>>")).alias("ports"),
    )
    return hosts, judged.filter("reason is not null").select("scan_id", "reason")


def scan_observations(hosts: DataFrame, address: str = "address") -> DataFrame:
    """identity, open_ports and software observations of each host; ``hosts`` also has the scanned ``address``."""
    versioned = F.filter("ports", lambda p: p["product"].isNotNull() | p["version"].isNotNull())
    identity = F.to_json(F.struct(F.col(address).alias("ip"), "mac", F.col("vendor").alias("mac_vendor"), "hostname"))
    ports = F.to_json(F.struct(F.col(address).alias("ip"), F.transform("ports", lambda p: F.struct(p["port"].alias("port"), p["protocol"].alias("protocol"), p["service"].alias("service"), p["confidence"].alias("confidence"))).alias("ports")))
    parts = F.transform(versioned, lambda p: F.struct(F.coalesce(p["product"], p["service"]).alias("name"), p["version"].alias("version"), p["port"].alias("port"), p["protocol"].alias("protocol"), p["confidence"].alias("confidence")))
    software = F.to_json(F.struct(F.col(address).alias("ip"), parts.alias("components")))
    one = lambda kind, payload, confidence, source: F.struct(F.lit(kind).alias("observation_type"), payload.alias("payload"), confidence.alias("confidence"), F.lit(source).cast("string").alias("version_source"))
    sure = F.lit(PORT_CONFIDENCE)
    known = F.coalesce("mac", "vendor", "hostname").isNotNull()
    rows = F.array(
        F.when(known, one("identity", identity, sure, None)),
        F.when(F.size("ports") > 0, one("open_ports", ports, sure, None)),
        F.when(F.size(versioned) > 0, one("software", software, F.array_max(F.transform(versioned, lambda p: p["confidence"])), "banner")),
    )
    return hosts.select("scan_id", address, "observed_at", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("o")).select("scan_id", F.col(address).alias("source_identifier"), "observed_at", "o.*")


def _upto(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def _lines(text: Column, most: int | None = MAX_LINES) -> Column:
    every = _upto(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), most)
    return F.filter(F.transform(every, lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")


def _components(pairs: Column, most: int | None = MAX_COMPONENTS) -> Column:
    named = F.transform(pairs, lambda c: F.struct(clean(c["name"]).alias("name"), clean(c["version"]).alias("version")))
    return _upto(F.filter(named, lambda c: c["name"].isNotNull()), most)


def dpkg_components(text: Column, max_lines: int | None = MAX_LINES, max_components: int | None = MAX_COMPONENTS) -> Column:
    """Installed packages of ``dpkg -l``: states ii and hi, without architecture. The bounds may be None: no bound."""
    pattern = r"^([a-zA-Z]{2,3})\s+(\S+)\s+(\S+)"
    rows = F.filter(_lines(text, max_lines), lambda x: F.regexp_extract(x, pattern, 1).isin("ii", "hi"))
    return _components(F.transform(rows, lambda x: F.struct(F.split_part(F.regexp_extract(x, pattern, 2), F.lit(":"), F.lit(1)).alias("name"), F.regexp_extract(x, pattern, 3).alias("version"))), max_components)


def rpm_components(text: Column, max_lines: int | None = MAX_LINES, max_components: int | None = MAX_COMPONENTS) -> Column:
    """Packages of ``rpm -qa``, read from the right: name-version-release.arch."""
    pattern = r"^(.+)-([^-\s]+)-([^-\s]+)\.([A-Za-z0-9_]+)$"
    rows = F.filter(_lines(text, max_lines), lambda x: x.rlike(pattern))
    return _components(F.transform(rows, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("name"), F.concat_ws("-", F.regexp_extract(x, pattern, 2), F.regexp_extract(x, pattern, 3)).alias("version"))), max_components)


def os_release(text: Column) -> Column:
    """``/etc/os-release`` as a map; the last value of a key counts, quotes go."""
    pattern = r"^([A-Z_][A-Z0-9_]*)=(.*)$"
    rows = F.filter(_lines(text), lambda x: x.rlike(pattern))
    value = lambda x: clean(F.regexp_replace(F.btrim(F.regexp_extract(x, pattern, 2)), r"^(['\"])(.*)\1$", "$2"))
    pairs = F.filter(F.transform(rows, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), value(x).alias("v"))), lambda p: p["v"].isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), -1)))


def os_component(release: Column, kernel: Column) -> Column:
    """(name, version) of the operating system: from os-release, else the kernel text cut at its first space."""
    at = lambda k: F.try_element_at(release, F.lit(k))
    name, version, k = F.coalesce(at("ID"), at("NAME")), F.coalesce(at("VERSION_ID"), at("VERSION")), clean(kernel)
    rest = F.nullif(F.btrim(F.substring(k, F.length(F.split_part(k, F.lit(" "), F.lit(1))) + 2, F.lit(MAX_FIELD))), F.lit(""))
    stated = F.struct(name.alias("name"), version.alias("version"))
    return F.when(name.isNotNull(), stated).when(k.isNotNull(), F.struct(F.split_part(k, F.lit(" "), F.lit(1)).alias("name"), rest.alias("version")))


def inspect(devices: DataFrame, max_lines: int | None = MAX_LINES, max_components: int | None = MAX_COMPONENTS) -> tuple[DataFrame, DataFrame]:
    """Components (device_id, seq, name, version, version_source, confidence) of devices (device_id, os_release, kernel, dpkg, rpm): the
    system first, then packages. Devices without any component are refused, and those whose lists are longer than the bounds
    (None: no bound) are named among the refusals besides: what was read of them is not all there is."""
    none = F.array().cast("array<struct<name:string,version:string>>")
    os = os_component(F.coalesce(os_release(F.col("os_release")), F.create_map().cast("map<string,string>")), F.col("kernel"))
    all_ = F.concat(F.when(os.isNotNull(), F.array(os)).otherwise(none), F.coalesce(dpkg_components(F.col("dpkg"), max_lines, max_components), none), F.coalesce(rpm_components(F.col("rpm"), max_lines, max_components), none))
    longer = F.lit(False)
    for c, read in (("dpkg", dpkg_components), ("rpm", rpm_components)):
        longer = longer | F.coalesce(F.size(read(F.col(c), max_lines, max_components)) < F.size(read(F.col(c), None, None)), F.lit(False))
    rows = devices.select("device_id", all_.alias("cs"), longer.alias("longer"))
    good = rows.select("device_id", F.posexplode("cs").alias("seq", "c")).select("device_id", "seq", "c.name", "c.version", F.lit("package_manager").alias("version_source"), F.lit(PACKAGE_CONFIDENCE).alias("confidence"))
    reason = F.when(F.size("cs") == 0, "no software could be read").when(F.col("longer"), "a package list is longer than what is read of it")
    return good, rows.select("device_id", reason.alias("reason")).filter("reason is not null")


def scan_anchors(hosts: DataFrame, address: str = "address") -> DataFrame:
    """(scan_id, seq, kind, value, confidence) of scanned hosts: MAC and name where seen, and always the address scanned.

    A name is a locator; the address is what the scan aimed at, so there is something to know the host by.
    """
    # Confidences of the three.
    three = [("mac", "mac", PORT_CONFIDENCE), ("hostname", "hostname", 0.5), ("ip", address, PORT_CONFIDENCE)]
    found = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"), F.col(c).alias("value"), F.lit(sure).alias("confidence")) for i, (kind, c, sure) in enumerate(three)])
    return hosts.select("scan_id", F.explode(F.filter(found, lambda a: a["value"].isNotNull())).alias("a")).select("scan_id", "a.*")


def inspection_observations(devices: DataFrame) -> DataFrame:
    """Software and identity observations of inspected devices (also with ``address`` and ``hostname``, the device's own answer).

    Devices without any component give none; an identity only where the device told a name.
    """
    good, _ = inspect(devices)
    parts = good.groupBy("device_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name", "version"))), lambda c: F.struct(c["name"].alias("name"), c["version"].alias("version"))).alias("components"))
    rows = devices.select("device_id", "address", clean(F.split_part(F.replace("hostname", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(1))).alias("name")).join(parts, "device_id")
    software = F.struct(F.lit("software").alias("observation_type"), F.to_json(F.struct(F.col("address").alias("ip"), "components")).alias("payload"), F.lit("package_manager").alias("version_source"))
    identity = F.struct(F.lit("identity").alias("observation_type"), F.to_json(F.struct(F.col("address").alias("ip"), F.col("name").alias("hostname"))).alias("payload"), F.lit(None).cast("string").alias("version_source"))
    both = F.filter(F.array(software, F.when(F.col("name").isNotNull(), identity)), lambda o: o.isNotNull())
    return rows.select("device_id", F.explode(both).alias("o")).select("device_id", "o.*", F.lit(PACKAGE_CONFIDENCE).alias("confidence"))
