"""Queries of the write side, the scan policy and the caches, each with independent SQL for the oracle's engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate, dossier, identity, reconcile, scan, store, temporal, triage
from ..sources import scans
from ..storage import shared_dir
from ..streaming import jobs
from .domain import MATCHES, RECON, _recon
from .fixtures import AS_OF, oracle, spark_sql, view
from .streams import drained, source

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


# --- correlation runs --------------------------------------------------------------------------------------------------


def _run(spark, d, table, some: str, epss_at: str):
    v = lambda n: view(spark, d, n)
    manifest = spark.sql(f"SELECT 'kev' AS source, 9L AS record_count, TIMESTAMP '2024-05-31 23:00:00' AS fetched_at UNION ALL SELECT 'epss', 9L, TIMESTAMP '{epss_at}'")
    return correlate.correlation_run(table, v("v_component").filter(some), *[v(n) for n in ("v_asset", "v_criteria", "v_cve", "v_kev", "v_epss")], manifest, F.lit(AS_OF).cast("timestamp"))


_TRIED = "(SELECT count(*) AS components, count(*) FILTER (WHERE NOT (starts_with(lower(trim(cpe)), 'cpe:2.3:') AND len(f) >= 6)) AS skipped FROM comp0)"
_COUNTED = """count(*) AS matches, count(*) FILTER (WHERE kev) AS kev_matches, count(*) FILTER (WHERE priority = 'p1') AS p1, count(*) FILTER (WHERE confidence_state = 'confirmed') AS confirmed,
  count(*) FILTER (WHERE confidence_state = 'probable') AS probable, count(*) FILTER (WHERE verdict = 'inconclusive') AS inconclusive"""


@register("correlate_run", f"""WITH {MATCHES} SELECT *, components - skipped AS correlated, 0 AS failed FROM {_TRIED}, (SELECT {_COUNTED} FROM found),
  (SELECT count(*) AS new_matches FROM (SELECT tenant_id, asset_id, cve_id, matched_cpe FROM found GROUP BY ALL HAVING bool_and(component_id % 2 = 1)))""")
def correlate_run(spark, d):
    """A second run after one over every other component: what it adds is new, the rest is updated."""
    table = correlate.MatchTable(spark, shared_dir(spark))
    _run(spark, d, table, "component_id % 2 = 0", "2024-05-31 12:00:00")
    return _run(spark, d, table, "true", "2024-05-31 12:00:00")


@register("correlate_run_stale", f"""WITH {MATCHES} SELECT *, components - skipped - failed AS correlated, 0 AS new_matches FROM {_TRIED}, (SELECT {_COUNTED} FROM found WHERE false),
  (SELECT count(DISTINCT tenant_id * 1000000000000 + component_id) AS failed FROM found)""")
def correlate_run_stale(spark, d):
    return _run(spark, d, correlate.MatchTable(spark, shared_dir(spark)), "true", "2024-05-20 12:00:00")


# --- reconciliation and identity ---------------------------------------------------------------------------------------

_PAYLOAD = """SELECT tenant_id, record_id, source, external_id, '{"serial": "' || coalesce(serial, '  ') || '", "hostname": "' || coalesce(hostname, '') || '"' || CASE WHEN mac IS NULL THEN '' ELSE ', "mac": "' || mac || '"' END || '}' AS payload FROM v_managed"""


@register("record_fields", f"""SELECT tenant_id, record_id, source, external_id, nullif(trim(json_extract_string(payload, '$.serial')), '') AS serial, nullif(trim(json_extract_string(payload, '$.mac')), '') AS mac,
  nullif(trim(json_extract_string(payload, '$.hostname')), '') AS hostname FROM ({_PAYLOAD})""")
def record_fields(spark, d):
    return reconcile.record_fields(spark_sql(spark, d, _PAYLOAD))


@register("write_back_records", f"WITH {RECON} SELECT m.tenant_id, m.record_id, oc.asset_id AS linked_asset_id FROM v_managed m JOIN oc ON oc.record_id = m.record_id AND oc.tenant_id = m.tenant_id")
def write_back_records(spark, d):
    records = view(spark, d, "v_managed").select("tenant_id", "record_id", F.lit(-1).cast("long").alias("linked_asset_id"))
    return reconcile.write_back(records, view(spark, d, "v_asset"), *_recon(spark, d))[0]


@register("write_back_states", f"WITH {RECON} SELECT a.tenant_id, a.asset_id, coalesce(pa.management_state, a.management_state) AS management_state, a.status FROM v_asset a LEFT JOIN pa USING (tenant_id, asset_id)")
def write_back_states(spark, d):
    return reconcile.write_back(view(spark, d, "v_managed"), view(spark, d, "v_asset").select("tenant_id", "asset_id", "management_state", "status"), *_recon(spark, d))[1]


_HELD = "SELECT tenant_id, kind, value, asset_id, confidence, CASE WHEN asset_id % 2 = 0 THEN asset_id END AS observation_id, TIMESTAMP '2024-01-15 00:00:00' AS last_seen_at FROM v_owner JOIN v_identifier USING (tenant_id, asset_id, kind, value)"
_SEEN = "SELECT s.tenant_id, kind, s.value, confidence + 5e-2 AS confidence, CASE WHEN sighting_id % 3 = 0 THEN sighting_id END AS observation_id, CAST(ts AS TIMESTAMP) AS observed_at FROM v_sighting s JOIN @events@ ON event_id = sighting_id"


@register("accumulate_anchors", f"""WITH h AS ({_HELD}), s AS ({_SEEN}), last AS (SELECT tenant_id, kind, value, observation_id FROM s WHERE observation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant_id, kind, value ORDER BY observed_at DESC, observation_id DESC) = 1),
  top AS (SELECT tenant_id, kind, value, max(confidence) AS c, max(observed_at) AS t FROM s GROUP BY ALL)
SELECT h.tenant_id, h.kind, h.value, asset_id, greatest(confidence, c) AS confidence, coalesce(last.observation_id, h.observation_id) AS observation_id, greatest(last_seen_at, t) AS last_seen_at FROM h LEFT JOIN top USING (tenant_id, kind, value) LEFT JOIN last USING (tenant_id, kind, value)""")
def accumulate_anchors(spark, d):
    return identity.accumulate_anchors(spark_sql(spark, d, _HELD), spark_sql(spark, d, _SEEN))


# --- scans -------------------------------------------------------------------------------------------------------------


@register("scan_commands", """SELECT target_id, CASE WHEN target_id % 3 = 2 THEN NULL WHEN target_id % 3 = 0 THEN 'nmap -sS -sV -T3 --max-retries 2 --host-timeout 600s --top-ports 1000 -oX - ' || address
  ELSE 'nmap -sS -sV --version-intensity 0 -T2 --scan-delay 200ms --max-rate 50 --max-parallelism 1 --max-retries 1 --host-timeout 300s -p 21,22,23,25,53,80,81,88,443,445,515,554,631,1883,2000,3389,5000,5060,5061,7547,8000,8008,8080,8081,8443,8554,8883,9100,37777,49152 -oX - ' || address END AS command FROM v_target""")
def scan_commands(spark, d):
    t = view(spark, d, "v_target")
    profile = F.when(F.col("target_id") % 3 == 0, "standard").when(F.col("target_id") % 3 == 1, "gentle").otherwise("fast")
    return t.select("target_id", F.array_join(scan.scan_command(F.col("address"), profile), " ").alias("command"))


_COMMANDS = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'cat /etc/os-release' WHEN 1 THEN 'cat /etc/shadow' WHEN 2 THEN 'rm -rf /' WHEN 3 THEN 'dpkg -l; reboot' WHEN 4 THEN ' uname -n' WHEN 5 THEN 'uname -n' WHEN 6 THEN '' WHEN 7 THEN 'rpm -qa' ELSE text END AS command FROM @documents@"""


@register("command_guard", f"""SELECT doc_id, CASE WHEN doc_id % 9 IN (0, 5, 7) THEN NULL WHEN doc_id % 9 = 1 THEN 'arguments are not allowed' WHEN doc_id % 9 = 2 THEN 'verb is not allowed' WHEN doc_id % 9 = 3 THEN 'shell metacharacters' WHEN doc_id % 9 IN (4, 6) THEN 'malformed command'
  WHEN command IS NULL OR command = '' OR command <> trim(command, ' ') THEN 'malformed command' WHEN len(list_filter(string_split(command, ''), lambda c: contains(chr(59) || '&|><`$()[]{{}}!*?~' || chr(10) || chr(13) || chr(9) || chr(92) || chr(39) || chr(34), c))) > 0 THEN 'shell metacharacters' ELSE 'verb is not allowed' END AS fault FROM ({_COMMANDS})""")
def command_guard(spark, d):
    return spark_sql(spark, d, _COMMANDS).select("doc_id", scan.command_fault(F.col("command")).alias("fault"))


@register("distress_observations", """SELECT run_id, pos, 'device_health' AS observation_type, '{"ip":"10.0.0.' || user_id % 250 || '","state":"tripped","profile":"gentle","mac":' || CASE WHEN user_id % 2 = 0 THEN '"m' || user_id || '"' ELSE 'null' END || '}' AS payload,
  'health_probe' AS source, 'active_scan' AS source_type, '10.0.0.' || user_id % 250 AS source_identifier, 'circuit_breaker' AS collection_method, 9e-1 AS confidence
FROM v_scan_event WHERE authorized AND NOT credentialed AND pre_ok AND (scan_result = 'timeout' OR (scan_result = 'ok' AND NOT post_ok))""")
def distress_observations(spark, d):
    rows = scan.scan_outcome(view(spark, d, "v_scan_event"))
    who = F.col("user_id").cast("string")
    target = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))
    return scan.distress_observations(rows.select("run_id", "pos", target.alias("target"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("m"), who)).alias("mac"), F.lit("gentle").alias("profile"), "outcome"))


_SPOKEN = "SELECT a.asset_id, max(CASE WHEN o.observation_id % 2203 IN (22, 443) THEN o.observation_id % 2203 END) AS p FROM v_asset a LEFT JOIN v_observation o ON o.asset_id = a.asset_id AND o.tenant_id = a.tenant_id GROUP BY a.asset_id"


@register("inspectors", f"SELECT asset_id, CASE WHEN asset_id % 3 > 0 AND (p = 22 OR asset_id % 7 = 0) THEN 'ssh' END AS inspector FROM ({_SPOKEN})")
def inspectors(spark, d):
    rows = spark_sql(spark, d, _SPOKEN)
    banners = F.when(F.col("asset_id") % 7 == 0, F.array(F.lit(None).cast("string"), F.lit(" ssh-2.0-x"))).otherwise(F.array(F.lit("220 ftp")))
    return rows.select("asset_id", scan.inspector_for(F.col("asset_id") % 3 > 0, F.array(F.col("p").cast("int")), banners).alias("inspector"))


_HOSTS = "SELECT asset_id AS scan_id, max(CASE WHEN kind = 'ip' THEN value END) AS address, max(CASE WHEN kind = 'mac' THEN value END) AS mac, max(CASE WHEN kind = 'hostname' THEN value END) AS hostname FROM v_identifier GROUP BY asset_id"


@register("scan_anchors", "SELECT asset_id AS scan_id, CASE kind WHEN 'mac' THEN 0 WHEN 'hostname' THEN 1 ELSE 2 END AS seq, kind, value, CASE kind WHEN 'hostname' THEN 5e-1 ELSE 9e-1 END AS confidence FROM v_identifier WHERE kind <> 'serial'")
def scan_anchors(spark, d):
    return scans.scan_anchors(spark_sql(spark, d, _HOSTS))


_DEVICES = """SELECT c_custkey AS device_id, '10.0.0.' || CAST(c_custkey % 250 AS STRING) AS address, CASE WHEN c_custkey % 3 > 0 THEN 'host-' || CAST(c_custkey AS STRING) END AS hostname, CAST(NULL AS STRING) AS os_release, CAST(NULL AS STRING) AS kernel,
  CASE WHEN c_custkey % 4 > 0 THEN 'ii  zlib:amd64  1.' || CAST(c_custkey % 9 AS STRING) || '  amd64  lib' END AS dpkg, CASE WHEN c_custkey % 5 = 0 THEN 'bash-5.' || CAST(c_custkey % 3 AS STRING) || '-1.el9.x86_64' END AS rpm FROM @customer@"""


@register("inspection_observations", f"""WITH dv AS ({_DEVICES}), c AS (SELECT *, CASE WHEN dpkg IS NOT NULL THEN '{{"name":"zlib","version":"1.' || device_id % 9 || '"}}' END AS a, CASE WHEN rpm IS NOT NULL THEN '{{"name":"bash","version":"5.' || device_id % 3 || '-1.el9"}}' END AS b FROM dv WHERE dpkg IS NOT NULL OR rpm IS NOT NULL)
SELECT device_id, 'software' AS observation_type, '{{"ip":"' || address || '","components":[' || concat_ws(',', a, b) || ']}}' AS payload, 'package_manager' AS version_source, (SELECT 95e-2) AS confidence FROM c
UNION ALL SELECT device_id, 'identity', '{{"ip":"' || address || '","hostname":"' || hostname || '"}}', NULL, 95e-2 FROM c WHERE hostname IS NOT NULL""")
def inspection_observations(spark, d):
    return scans.inspection_observations(spark_sql(spark, d, _DEVICES))


# --- feeds and caches --------------------------------------------------------------------------------------------------

_CACHE = "SELECT criteria AS cpe, collect_list(cve_id) AS cve_ids, CASE WHEN criteria LIKE '%vendor1%' THEN TIMESTAMP '2024-05-30 00:00:00' ELSE TIMESTAMP '2024-05-31 12:00:00' END AS fetched_at FROM v_criteria GROUP BY criteria"


@register("cached_records", "SELECT DISTINCT c.criteria AS cpe, v.cve_id, v.cvss_score FROM v_criteria c JOIN v_cve v USING (cve_id) WHERE c.criteria NOT LIKE '%vendor1%'")
def cached_records(spark, d):
    return store.cached_records(spark_sql(spark, d, _CACHE), view(spark, d, "v_cve").select("cve_id", "cvss_score"), F.lit(AS_OF).cast("timestamp"), 24)


_ASKED = "SELECT ' ' || lower(cve_id) || ' ' AS asked FROM v_cve UNION ALL SELECT 'CVE-1999-' || CAST(p_partkey AS STRING) FROM @part@ UNION ALL SELECT 'cve ' || CAST(p_partkey AS STRING) FROM @part@"


@register("cve_lookup", f"WITH q AS ({_ASKED}), s AS (SELECT asked, CASE WHEN regexp_full_match(upper(trim(asked)), 'CVE-[0-9]+-[0-9]+') THEN upper(trim(asked)) END AS cve_id FROM q) SELECT asked, s.cve_id, v.cve_id IS NOT NULL AS cached, cvss_score FROM s LEFT JOIN v_cve v ON v.cve_id = s.cve_id")
def cve_lookup(spark, d):
    return store.lookup(spark_sql(spark, d, _ASKED), view(spark, d, "v_cve").select("cve_id", "cvss_score"))


@register("request_spacing", """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 s AS (SELECT event_id, user_id, i, ts AS starts FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.i, greatest(e.ts, s.starts + INTERVAL 36 HOUR) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, CAST(starts AS TIMESTAMP) AS starts FROM s""")
def request_spacing(spark, d):
    e = spark_sql(spark, d, "SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM @events@")
    return temporal.spaced(e, ["user_id"], "ts", ["event_id"], 36 * 3600).select("event_id", "starts")


# --- dossiers and triage -----------------------------------------------------------------------------------------------


@register("derived_provenance", f"SELECT asset_id, management_state, 'reconciliation' AS source, 'derived' AS source_type, 'deterministic' AS derivation, 1e0 AS confidence, TIMESTAMP '{AS_OF}' AS observed_at FROM v_asset")
def derived_provenance(spark, d):
    p = dossier.derived_provenance(F.lit(AS_OF).cast("timestamp"))
    rows = view(spark, d, "v_asset").withColumn("p", p)
    return rows.select("asset_id", "management_state", "p.source", "p.source_type", "p.derivation", "p.confidence", "p.observed_at")


_DOCUMENT = """SELECT triage_id, tenant_id, asset_id, cve_id, '{"cve": "' || cve_id || '",  "asset": {"z": ' || CAST(asset_id AS STRING) || ', "a": [true, null]}}' AS document FROM v_snapshot"""


@register("triage_snapshots", """SELECT triage_id, tenant_id, asset_id, cve_id, CAST(NULL AS VARCHAR) AS match_id, s AS snapshot, sha256(s) AS content_hash FROM (SELECT *, '{"asset":{"a":[true,null],"z":' || asset_id || '},"cve":"' || cve_id || '"}' AS s FROM v_snapshot)""")
def triage_snapshots(spark, d):
    return triage.snapshots(spark_sql(spark, d, _DOCUMENT))


_PROPOSED = "SELECT insight_id, triage_id, recommendation, CASE WHEN insight_id % 5 = 0 THEN 0 WHEN insight_id % 11 = 0 THEN NULL ELSE 2 END AS n_cited, kev_locked_visible FROM v_insight"


@register("recorded_insights", f"""SELECT p.*, s.tenant_id, CASE WHEN coalesce(n_cited, 0) = 0 THEN 'no cited source' WHEN kev_locked_visible AND recommendation = 'lower_priority' THEN 'hides a known-exploited finding' WHEN s.tenant_id IS NULL THEN 'no retained snapshot' END AS problem
FROM ({_PROPOSED}) p LEFT JOIN (SELECT * FROM v_snapshot WHERE triage_id % 13 > 0) s ON s.triage_id = p.triage_id""")
def recorded_insights(spark, d):
    return triage.recorded_insights(spark_sql(spark, d, _PROPOSED), view(spark, d, "v_snapshot").filter("triage_id % 13 > 0"))


# --- streams -----------------------------------------------------------------------------------------------------------

_SIGNALS = "SELECT c_custkey AS user_id, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS fetched_at, c_acctbal AS signal FROM @customer@ WHERE c_custkey % 3 > 0"


@register("stream_fresh_signals", """SELECT event_id, s.user_id IS NOT NULL AND CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-01 00:00:00' AND CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-11 00:00:00' AS fresh,
  CASE WHEN CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-01 00:00:00' AND CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-11 00:00:00' THEN signal END AS signal FROM events e LEFT JOIN (SELECT c_custkey AS user_id, c_acctbal AS signal FROM customer WHERE c_custkey % 3 > 0) s USING (user_id)""")
def stream_fresh_signals(spark, d):
    s = source(spark, spark_sql(spark, d, "SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM @events@"))
    return drained(jobs.against_snapshot(s, spark_sql(spark, d, _SIGNALS), "user_id", "ts", 240)).select("event_id", "fresh", "signal")
