"""Priority, correlation and reconciliation rules on small tables."""

import itertools

from pyspark.sql import functions as F

from harborlight.operators import correlate, reconcile
from harborlight.operators.priority import TABLE, Row, priority_of, with_priority

SCHEMA = "cve_id string, confidence_state string, kev boolean, epss double, cvss_score double"


def band(state, kev, epss, cvss):
    act = state != "probable"
    e, c = -1 if epss is None else epss, -1 if cvss is None else cvss
    if state == "verified_exploitable" or kev or (act and e >= 0.1):
        return "p1"
    if act and (c >= 7 or e >= 0.01) or e >= 0.1:
        return "p2"
    return "p3" if act or c >= 7 or e >= 0.01 else "p4"


def test_every_combination(spark):
    grid = list(itertools.product(["CVE-1-1"], ["probable", "confirmed", "verified_exploitable"], [True, False], [None, 0.0, 0.009, 0.01, 0.0999, 0.1, 1.0], [None, 0.0, 6.9, 7.0, 8.9, 9.0, 10.0]))
    rows = with_priority(spark.createDataFrame(grid, SCHEMA)).collect()
    assert all(r.priority == band(r.confidence_state, r.kev, r.epss, r.cvss_score) for r in rows)
    assert all(r.priority_reason for r in rows)


def test_wording(spark):
    rows = with_priority(spark.createDataFrame([("CVE-1-1", "confirmed", False, 0.125, None), ("CVE-1-2", "confirmed", False, None, 9.8), ("CVE-1-3", "confirmed", False, None, None)], SCHEMA)).collect()
    assert " at 12% in" in rows[0].priority_reason and "critical at 9.8," in rows[1].priority_reason
    assert rows[2].priority_reason.startswith("The installed version is confirmed from the device's own")


def test_floor_holds_whatever_the_rules(spark):
    wrong = [Row("odd", "p4", (), False, None, None, "no"), *TABLE]
    row = spark.createDataFrame([("CVE-1-1", "probable", True, None, None)], SCHEMA)
    got = row.select(priority_of(*[F.col(c) for c in ("cve_id", "confidence_state", "kev", "epss", "cvss_score")], wrong).alias("p")).first().p
    assert (got.priority, got.priority_rule) == ("p2", "kev-floor") and "'odd' would have given P4" in got.priority_reason


def _estate(spark):
    assets = spark.createDataFrame([(1, 1, "active"), (1, 2, "merged")], "tenant_id long, asset_id long, status string")
    component = "tenant_id long, asset_id long, component_id long, cpe string, name string, version string, version_source string, is_current boolean"
    rows = [
        (1, 1, 10, "cpe:2.3:a:v:p:1.5:*:*:*:*:*:*:*", "p", "9.9", "package_manager", True),
        (1, 1, 11, "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "q", None, "package_manager", True),
        (1, 1, 12, "nonsense", "n", "1", "banner", True),
        (1, 1, 13, None, "x", "1", "banner", True),
        (1, 2, 14, "cpe:2.3:a:v:p:1.5:*:*:*:*:*:*:*", "p", "1.5", "banner", True),
        (1, 1, 15, "cpe:2.3:a:v:p:1.5:*:*:*:*:*:*:*", "old", "1.5", "banner", False),
    ]
    crit = "cve_id string, pos long, criteria string, vulnerable boolean, start_including string, start_excluding string, end_including string, end_excluding string"
    any_, pin = "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "cpe:2.3:a:v:p:1.5:*:*:*:*:*:*:*"
    criteria = [
        ("CVE-1-1", 0, any_, True, None, None, "1.0", None),  # out of range before
        ("CVE-1-1", 1, any_, True, "1.0", None, None, "2.0"),
        ("CVE-1-1", 2, any_, True, None, None, "1.2", None),  # out of range after: not counted
        ("CVE-1-2", 0, any_, True, "latest", None, None, None),
        ("CVE-1-3", 0, pin, True, None, None, "1.2", None),  # a pinned version with bounds: only the bounds count
        ("CVE-1-4", 0, pin, True, None, None, None, None),
        ("CVE-1-5", 0, pin, False, None, None, None, None),
    ]
    cves = [(f"CVE-1-{i}", 5.0) for i in range(1, 6)]
    return (
        spark.createDataFrame(rows, component),
        assets,
        spark.createDataFrame(criteria, crit),
        spark.createDataFrame(cves, "cve_id string, cvss_score double"),
        spark.createDataFrame([("CVE-1-1",)], "cve_id string"),
        spark.createDataFrame([("CVE-1-4", 0.5)], "cve_id string, score double"),
    )


def test_correlation(spark):
    rows = {(r.component_id, r.cve_id): r for r in correlate.correlate(*_estate(spark)).collect()}
    assert rows[10, "CVE-1-1"].verdict == "in_range" and rows[10, "CVE-1-1"].filtered == 1 and rows[10, "CVE-1-1"].kev
    assert rows[10, "CVE-1-2"].confidence_state == "probable"  # undecided, whatever its source
    assert (10, "CVE-1-3") not in rows and rows[10, "CVE-1-4"].epss == 0.5 and (10, "CVE-1-5") not in rows
    assert rows[11, "CVE-1-4"].verdict == "inconclusive"  # no version on either side
    assert {c for c, _ in rows} == {10, 11}


def test_two_components_of_an_asset_collapse_to_the_last_by_name(spark):
    found = correlate.correlate(*_estate(spark))
    m = correlate.current_matches(found).filter("cve_id = 'CVE-1-4'").collect()
    assert [(r.component_id, r.name) for r in m] == [(11, "q")] and found.filter("cve_id = 'CVE-1-4'").count() == 2


def test_reconciliation(spark):
    assets = spark.createDataFrame([(1, i, "active") for i in range(1, 8)], "tenant_id long, asset_id long, status string")
    ids = [(1, 1, "serial", "sn1"), (1, 2, "mac", "AA:BB:CC:00:00:02"), (1, 3, "hostname", "srv-app-03.corp.local."), (1, 4, "hostname", "dup"), (1, 5, "hostname", "DUP.x"), (1, 6, "ip", "10.0.0.6"), (1, 1, "hostname", "one"), (1, 7, "hostname", "lonely")]
    identifiers = spark.createDataFrame(ids, "tenant_id long, asset_id long, kind string, value string")
    records = [
        (1, 100, "a", "SN1 ", None, None), (1, 101, "b", None, None, "srvapp03"), (1, 102, "c", None, None, "dup"), (1, 103, "d", "sn1", "aa:bb:cc:00:00:02", None),
        (1, 104, "e", None, None, "gone"), (1, 105, "f", None, None, "ONE"), (2, 106, "g", "sn1", None, None),
    ]
    out = reconcile.record_outcomes(spark.createDataFrame(records, "tenant_id long, record_id long, external_id string, serial string, mac string, hostname string"), assets, identifiers)
    got = {r.record_id: (r.category, r.asset_id, list(r.matched_on), list(r.candidates)) for r in out.collect()}
    assert got[100] == ("matched", 1, ["serial"], []) and got[101] == ("ambiguous", None, [], [3]) and got[102] == ("ambiguous", None, [], [4, 5])
    assert got[103] == ("ambiguous", None, [], [1, 2]) and got[104][0] == "stale" and got[105] == ("matched", 1, ["hostname"], []) and got[106][0] == "stale"
    per = {r.asset_id: (r.category, r.management_state) for r in reconcile.asset_outcomes(out, assets, identifiers).collect()}
    assert per[1] == ("matched", "managed")  # linked beats entangled
    assert per[2] == ("ambiguous", "unknown") and per[6] == ("ambiguous", "unknown") and per[7] == ("unmanaged", "unmanaged")
    assert len(per) == 7  # each asset in exactly one category
