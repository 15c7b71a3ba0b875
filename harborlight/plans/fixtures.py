"""The domain's relations over the generic test tables: one SQL text for Spark and for the oracle's engine.

``@table@`` stands for a base table. A view may read the views above it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-06-01 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["v_asset"] = """
SELECT CAST(floor(c_custkey / 50) AS BIGINT) % 4 AS tenant_id, c_custkey AS asset_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'server' WHEN 'BUILDING' THEN 'network_device' WHEN 'FURNITURE' THEN 'embedded'
                         WHEN 'HOUSEHOLD' THEN 'application' ELSE 'unknown' END AS asset_class,
       CASE WHEN c_custkey % 5 < 2 THEN 'managed' WHEN c_custkey % 5 < 4 THEN 'unmanaged' ELSE 'unknown' END AS management_state,
       CASE WHEN c_acctbal < 0 THEN 6e-1 WHEN c_acctbal < 5000 THEN 8e-1 ELSE 9e-1 END AS identification_confidence,
       CASE WHEN c_custkey % 50 >= 48 THEN 'merged' ELSE 'active' END AS status,
       CASE WHEN c_custkey % 50 >= 48 THEN c_custkey - 1 END AS merged_into
FROM @customer@
"""

VIEWS["v_identifier"] = """
SELECT CAST(floor(c_custkey / 50) AS BIGINT) % 4 AS tenant_id, c_custkey AS asset_id, 'serial' AS kind,
       'SN' || CAST(100000 + c_custkey AS STRING) AS value, 9e-1 AS confidence
FROM @customer@ WHERE c_custkey % 3 = 0
UNION ALL
SELECT CAST(floor(c_custkey / 50) AS BIGINT) % 4, c_custkey, 'mac',
       '02:00:00:' || substr(CAST(1000000 + c_custkey % 1000000 AS STRING), 2, 2) || ':' || substr(CAST(1000000 + c_custkey % 1000000 AS STRING), 4, 2)
                   || ':' || substr(CAST(1000000 + c_custkey % 1000000 AS STRING), 6, 2), 8e-1
FROM @customer@ WHERE c_custkey % 4 = 0
UNION ALL
SELECT CAST(floor(c_custkey / 50) AS BIGINT) % 4, c_custkey, 'hostname',
       CASE WHEN c_custkey % 7 = 0 THEN 'shared-' || CAST(CAST(floor(c_custkey / 14) AS BIGINT) AS STRING)
            WHEN c_custkey % 2 = 0 THEN 'host-' || CAST(c_custkey AS STRING) || '.corp.example'
            ELSE 'host-' || CAST(c_custkey AS STRING) END,
       CASE WHEN c_acctbal < 0 THEN 6e-1 ELSE 7e-1 END
FROM @customer@ WHERE c_custkey % 5 <> 0
UNION ALL
SELECT CAST(floor(c_custkey / 50) AS BIGINT) % 4, c_custkey, 'ip',
       '10.' || CAST(c_nationkey AS STRING) || '.' || CAST(CAST(floor(c_custkey / 250) AS BIGINT) % 250 AS STRING) || '.' || CAST(c_custkey % 250 AS STRING), 5e-1
FROM @customer@
"""

VIEWS["v_managed"] = """
SELECT CAST(floor(c_custkey / 50) AS BIGINT) % 4 AS tenant_id, c_custkey AS record_id, 'cmdb' AS source, 'CI-' || CAST(c_custkey AS STRING) AS external_id,
       CASE WHEN c_custkey % 7 = 0 OR c_custkey % 7 = 4 THEN ' sn' || CAST(100000 + c_custkey AS STRING) END AS serial,
       CASE WHEN c_custkey % 7 = 1 THEN '02:00:00:' || substr(CAST(1000000 + c_custkey % 1000000 AS STRING), 2, 2) || ':' || substr(CAST(1000000 + c_custkey % 1000000 AS STRING), 4, 2)
                   || ':' || substr(CAST(1000000 + c_custkey % 1000000 AS STRING), 6, 2)
            WHEN c_custkey % 7 = 4 THEN '02:00:00:' || substr(CAST(1000000 + (c_custkey + 1) % 1000000 AS STRING), 2, 2) || ':' || substr(CAST(1000000 + (c_custkey + 1) % 1000000 AS STRING), 4, 2)
                   || ':' || substr(CAST(1000000 + (c_custkey + 1) % 1000000 AS STRING), 6, 2) END AS mac,
       CASE WHEN c_custkey % 7 = 2 THEN 'HOST-' || CAST(c_custkey AS STRING) || '.CORP.EXAMPLE.'
            WHEN c_custkey % 7 = 3 THEN 'host' || CAST(c_custkey AS STRING)
            WHEN c_custkey % 7 = 5 THEN 'Shared-' || CAST(CAST(floor(c_custkey / 14) AS BIGINT) AS STRING) END AS hostname
FROM @customer@ WHERE c_custkey % 5 < 3
UNION ALL
SELECT s_suppkey % 4, 1000000000 + s_suppkey, 'cmdb', 'SUP-' || CAST(s_suppkey AS STRING), 'SUP' || CAST(s_suppkey AS STRING), NULL, 'stray-' || CAST(s_suppkey AS STRING)
FROM @supplier@
"""

_VERSION = (
    "CAST(1 + o_orderkey % 3 AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING) || '.' || CAST(CAST(floor(o_orderkey / 10) AS BIGINT) % 10 AS STRING) "
    "|| CASE WHEN o_orderkey % 11 = 0 THEN 'p1' WHEN o_orderkey % 11 = 1 THEN 'rc1' ELSE '' END"
)
VIEWS["v_component"] = f"""
SELECT CAST(floor(o_custkey / 50) AS BIGINT) % 4 AS tenant_id, o_custkey AS asset_id, o_orderkey AS component_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'cpe:/a:old:name'
            ELSE 'cpe:2.3:a:Vendor' || CAST(o_orderkey % 20 AS STRING) || ':pro\\\\:duct' || CAST(o_orderkey % 1000 AS STRING) || ':'
                 || CASE WHEN o_orderkey % 3 = 0 THEN '*' ELSE {_VERSION} END || ':*:*:*:*:*:*:*' END AS cpe,
       'product' || CAST(o_orderkey % 1000 AS STRING) AS name,
       CASE WHEN o_orderkey % 11 = 2 THEN NULL ELSE {_VERSION} END AS version,
       CASE o_orderstatus WHEN 'P' THEN 'package_manager' WHEN 'O' THEN 'vendor_api' ELSE 'banner' END AS version_source,
       o_orderpriority NOT LIKE '5%' AS is_current
FROM @orders@
"""

VIEWS["v_cve"] = """
SELECT 'CVE-' || CAST(2015 + p_partkey % 10 AS STRING) || '-' || CAST(10000 + p_partkey AS STRING) AS cve_id, p_partkey,
       CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size AS DOUBLE) / 5 END AS cvss_score
FROM @part@
"""

VIEWS["v_criteria"] = """
SELECT cve_id, CAST(0 AS BIGINT) AS pos, 'cpe:2.3:a:vendor' || CAST(p_partkey % 20 AS STRING) || ':pro\\\\:duct' || CAST(p_partkey % 1000 AS STRING) || ':*:*:*:*:*:*:*:*' AS criteria, true AS vulnerable,
       CASE WHEN p_partkey % 4 = 0 THEN '1.2' END AS start_including, CASE WHEN p_partkey % 4 = 1 THEN '1.1.5rc1' END AS start_excluding,
       CASE WHEN p_partkey % 3 = 0 THEN '2.5' END AS end_including, CASE WHEN p_partkey % 3 = 1 THEN '2.04.3' END AS end_excluding
FROM v_cve
UNION ALL
SELECT cve_id, 1, 'cpe:2.3:a:vendor' || CAST(p_partkey % 20 AS STRING) || ':pro\\\\:duct' || CAST(p_partkey % 1000 AS STRING) || ':3.' || CAST(p_partkey % 10 AS STRING) || '.1:*:*:*:*:*:*:*', p_partkey % 5 <> 0,
       NULL, NULL, CASE WHEN p_partkey % 6 = 0 THEN '3.9' END, NULL
FROM v_cve WHERE p_partkey % 2 = 0
UNION ALL
SELECT cve_id, 2, CASE WHEN p_partkey % 9 = 0 THEN 'cpe:2.3:a:broken' ELSE 'cpe:2.3:o:vendor' || CAST(p_partkey % 20 AS STRING) || ':pro\\\\:duct' || CAST(p_partkey % 1000 AS STRING) || ':-:*:*:*:*:*:*:*' END, true,
       'latest', NULL, NULL, NULL
FROM v_cve WHERE p_partkey % 3 = 0
"""

VIEWS["v_kev"] = "SELECT cve_id, p_partkey % 2 = 0 AS known_ransomware FROM v_cve WHERE p_partkey % 37 = 0"
VIEWS["v_epss"] = "SELECT cve_id, CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM v_cve WHERE p_partkey % 11 <> 0"

_EXTRA = """CASE event_id % 8
  WHEN 0 THEN '{"port": ' || CAST(event_id % 70000 AS STRING) || ', "protocol": "TCP", "service": "svc' || CAST(event_id % 9 AS STRING) || '", "banner": "x"}'
  WHEN 1 THEN '{"reachability": " Internal_Only ", "network_segment_label": "seg-' || CAST(user_id % 5 AS STRING) || '"}'
  WHEN 2 THEN '{"vendor": "V' || CAST(event_id % 4 AS STRING) || '", "model": "password: x1", "os_name": "linux", "raw": {"a": 1}}'
  WHEN 3 THEN '{"name": "daemon' || CAST(event_id % 6 AS STRING) || '", "pid": 7}'
  WHEN 4 THEN '{"telnet_enabled": true, "smb_signing": "required", "motd": "hi"}'
  WHEN 5 THEN '{"device_family": "cam", "firmware_version": "1.' || CAST(event_id % 7 AS STRING) || '", "list": [1]}'
  WHEN 6 THEN '{"app_name": "app", "behind_waf": "yes", "owner": "a.b@corp.example"}'
  ELSE '{"k": ' || CAST(event_id % 3 AS STRING) || ', "b": {"z": 1, "a": "q"}}' END"""
VIEWS["v_observation"] = f"""
SELECT event_id AS observation_id, CAST(floor(user_id / 50) AS BIGINT) % 4 AS tenant_id, user_id AS asset_id,
       CASE event_id % 8 WHEN 0 THEN 'open_ports' WHEN 1 THEN 'network' WHEN 2 THEN 'identity' WHEN 3 THEN 'service' WHEN 4 THEN 'config'
                         WHEN 5 THEN 'firmware' WHEN 6 THEN 'application' ELSE 'other' END AS observation_type,
       {_EXTRA} AS payload, event_type AS source, CASE WHEN event_id % 6 > 0 THEN CAST(user_id AS STRING) END AS source_identifier,
       CAST(ts AS DATE) AS run_id, CASE WHEN value > 50 THEN 9e-1 ELSE 6e-1 END AS confidence, CAST(ts AS TIMESTAMP) AS observed_at
FROM @events@
"""

VIEWS["v_scope"] = """
SELECT t.tenant_id, '10.' || CAST(n_nationkey AS STRING) || '.0.0/16' AS cidr, n_nationkey % 6 <> 5 AS active, CAST(NULL AS TIMESTAMP) AS expires_at
FROM @nation@ JOIN (SELECT DISTINCT tenant_id FROM v_asset) t ON n_nationkey % 4 <> t.tenant_id WHERE n_nationkey < 20
UNION ALL
SELECT t.tenant_id, '10.' || CAST(n_nationkey AS STRING) || '.1.0/24', true,
       CASE WHEN n_nationkey % 2 = 0 THEN CAST('2020-01-01 00:00:00' AS TIMESTAMP) ELSE CAST('2030-01-01 00:00:00' AS TIMESTAMP) END
FROM @nation@ JOIN (SELECT DISTINCT tenant_id FROM v_asset) t ON true
"""

VIEWS["v_vlan"] = """
SELECT t.tenant_id, '10.' || CAST(n_nationkey AS STRING) || '.0.0/16' AS cidr, 'site-' || n_name AS label
FROM @nation@ JOIN (SELECT DISTINCT tenant_id FROM v_asset) t ON n_nationkey % 3 <> 0
UNION ALL
SELECT t.tenant_id, '10.' || CAST(n_nationkey AS STRING) || '.0.128/25', 'lab-' || n_name
FROM @nation@ JOIN (SELECT DISTINCT tenant_id FROM v_asset) t ON true
"""

VIEWS["v_target"] = "SELECT tenant_id, asset_id AS target_id, value AS address FROM v_identifier WHERE kind = 'ip'"

VIEWS["v_snapshot"] = """
SELECT CAST(floor((doc_id % 150) / 50) AS BIGINT) % 4 AS tenant_id, doc_id AS triage_id, doc_id % 150 AS asset_id, CAST(NULL AS STRING) AS match_id,
       'CVE-' || CAST(2015 + doc_id % 10 AS STRING) || '-' || CAST(10000 + doc_id AS STRING) AS cve_id
FROM @labels@
"""

VIEWS["v_insight"] = """
SELECT CAST(floor((doc_id % 150) / 50) AS BIGINT) % 4 AS tenant_id, doc_id AS insight_id, doc_id AS triage_id,
       CASE WHEN toxic = 1 THEN 'raise_priority' WHEN quality = 0 THEN 'lower_priority' ELSE 'maintain' END AS recommendation,
       CASE WHEN doc_id % 3 = 0 THEN 'accepted' WHEN doc_id % 3 = 1 THEN 'human_reviewed' ELSE 'proposed' END AS state,
       doc_id % 7 = 0 AS kev_locked_visible, CASE WHEN doc_id % 3 < 2 AND doc_id % 10 > 0 THEN 'ana' END AS reviewer,
       CASE WHEN doc_id % 14 = 0 THEN 'lower_priority' END AS review_recommendation,
       CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence, doc_id % 1000 AS created_at
FROM @labels@
"""

VIEWS["v_review"] = """
SELECT conv_id * 1000 + turn AS event_id, conv_id AS insight_id, turn AS occurred_at,
       CASE WHEN turn % 5 = 4 THEN ' ' ELSE role END AS reviewer,
       CASE WHEN (conv_id + turn) % 4 = 0 THEN 'accepted' WHEN (conv_id + turn) % 4 = 1 THEN 'rejected' ELSE 'adjusted' END AS outcome,
       CASE WHEN (conv_id + turn) % 4 = 2 THEN 'lower_priority' WHEN (conv_id + turn) % 8 = 3 THEN 'maintain' END AS recommendation
FROM @conversations@
"""

VIEWS["v_scan_event"] = """
SELECT CAST(ts AS DATE) AS run_id, event_id AS pos, user_id, event_id % 9 <> 0 AS authorized, event_id % 11 = 0 AS credentialed,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 5 <> 1 END AS pre_ok,
       CASE WHEN event_id % 7 = 2 THEN 'timeout' WHEN event_id % 13 = 3 THEN 'error' ELSE 'ok' END AS scan_result, event_id % 6 <> 4 AS post_ok
FROM @events@
"""

VIEWS["v_sighting"] = """
SELECT CAST(floor(user_id / 50) AS BIGINT) % 4 AS tenant_id, event_id AS sighting_id, CAST(0 AS BIGINT) AS seq, 'serial' AS kind,
       'SN' || CAST(100000 + user_id AS STRING) AS value, 9e-1 AS confidence FROM @events@ WHERE event_id % 5 = 0
UNION ALL
SELECT CAST(floor(user_id / 50) AS BIGINT) % 4, event_id, 1, 'mac', '02:00:00:' || substr(CAST(1000000 + user_id + CASE WHEN event_id % 40 = 0 THEN 4 ELSE 0 END AS STRING), 2, 2) || ':'
       || substr(CAST(1000000 + user_id + CASE WHEN event_id % 40 = 0 THEN 4 ELSE 0 END AS STRING), 4, 2) || ':' || substr(CAST(1000000 + user_id + CASE WHEN event_id % 40 = 0 THEN 4 ELSE 0 END AS STRING), 6, 2), 8e-1
FROM @events@ WHERE event_id % 4 = 0
UNION ALL
SELECT CAST(floor(user_id / 50) AS BIGINT) % 4, event_id, 2, 'hostname', 'host-' || CAST(user_id AS STRING), 6e-1 FROM @events@ WHERE event_id % 2 = 0
UNION ALL
SELECT CAST(floor(user_id / 50) AS BIGINT) % 4, event_id, 3, 'ip', '10.0.0.' || CAST(user_id % 250 AS STRING), 5e-1 FROM @events@
"""

VIEWS["v_owner"] = "SELECT tenant_id, kind, value, asset_id FROM v_identifier WHERE kind IN ('serial', 'mac')"

VIEWS["v_advisory"] = "SELECT doc_id, 'CVE-' || CAST(2015 + doc_id % 10 AS STRING) || '-' || CAST(10000 + doc_id AS STRING) AS cve_id, text FROM @documents@"

_USES = re.compile(r"\b(v_\w+)\b")


def needed(sql: str) -> list[str]:
    """Views that ``sql`` reads, in order of definition."""
    found: set[str] = set()
    todo = set(_USES.findall(sql)) & VIEWS.keys()
    while todo:
        name = todo.pop()
        found.add(name)
        todo |= (set(_USES.findall(VIEWS[name])) & VIEWS.keys()) - found
    return [v for v in VIEWS if v in found]


def oracle(sql: str) -> str:
    """``sql`` over the views and base tables as one statement for the oracle's engine."""
    body = re.sub(r"@(\w+)@", r"\1", sql)
    parts = [f"{v} AS ({re.sub(r'@(\w+)@', r'\1', VIEWS[v]).replace(chr(92) * 2, chr(92))})" for v in needed(sql)]
    if not parts:
        return body
    text = body.lstrip()
    if text[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + text[15:]
    if text[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return "WITH " + ",\n".join(parts) + "\n" + text


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the views and base tables; nothing is registered in the catalog."""
    fill = lambda t: re.sub(r"@(\w+)@", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", t)
    parts = ",\n".join(f"{v} AS ({fill(VIEWS[v])})" for v in needed(sql))
    text = fill(sql).lstrip()
    if parts and text[:5].upper() == "WITH ":
        return spark.sql(f"WITH {parts},\n{text[5:]}")
    return spark.sql(f"WITH {parts}\n{text}" if parts else text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
