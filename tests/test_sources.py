"""Readers: golden and hostile inputs; every line or row is either read or refused with a reason."""

import gzip
import json
from datetime import datetime

import pytest

from harborlight.sources import captures, feeds, inventory, scans

AT = datetime(2024, 5, 1, 12)


def _captures(spark, kind, text):
    return spark.createDataFrame([(1, kind, AT, text)], "capture_id long, kind string, observed_at timestamp, text string")


def test_arp(spark):
    text = "# comment\n\n10.0.0.7 dev eth0 lladdr AA-bb-cc-dd-ee-1 REACHABLE\n10.0.0.8 dev eth0 lladdr aa:bb:cc:dd:ee:02 INCOMPLETE\n? (10.0.0.9) at a:b:c:1:2:3 on en0 ifscope\njunk\n10.0.0.999 dev eth0 lladdr aa:bb:cc:dd:ee:03 STALE\n10.0.0.5 dev e lladdr zz:bb:cc:dd:ee:03 STALE"
    good, bad = captures.read_arp(_captures(spark, "arp", text))
    assert {(r.target, r.mac, r.attributes["interface"]) for r in good.collect()} == {("10.0.0.7", "aa:bb:cc:dd:ee:01", "eth0"), ("10.0.0.9", "0a:0b:0c:01:02:03", "en0")}
    assert sorted((r.lineno, r.reason.split()[0]) for r in bad.collect()) == [(4, "unresolved"), (6, "unrecognised"), (7, "address"), (8, "hardware")]


def test_leases(spark):
    text = """lease 10.0.0.1 {
  starts 4 2024/05/01 10:15:22;
  ends 4 2024/05/02 10:15:22;
  binding state active;
  hardware ethernet AA:BB:CC:00:00:01;
  client-hostname "cam-1";
}
lease 10.0.0.2 {
  starts 4 2024/05/01 10:15:22;
  binding state free;
}
lease nowhere {
  binding state active;
}
lease 10.0.0.4 {
  starts 4 2024/05/01 10:15:22;
  binding state active;
"""
    good, bad = captures.read_leases(_captures(spark, "dhcp", text))
    r = good.collect()
    assert [(x.target, x.mac, x.hostname, x.observed_at, x.attributes) for x in r] == [("10.0.0.1", "aa:bb:cc:00:00:01", "cam-1", datetime(2024, 5, 1, 10, 15, 22), {"binding_state": "active", "lease_ends": "2024/05/02 10:15:22"})]
    assert sorted((x.lineno, x.reason) for x in bad.collect()) == [(8, "lease is not active or has no start"), (12, "lease address does not parse as an IP"), (15, "unterminated lease block")]


def test_mdns_and_all(spark):
    text = "+;eth0;IPv4;x;_ipp._tcp;local\n=;eth0;IPv4;Front\\032Cam;_rtsp._tcp;local;cam.local;10.0.0.3;554;txt\n=;a;b\n=;eth0;IPv4;x;_h._tcp;local;h;bad;1"
    good, bad = captures.read_captures(_captures(spark, "mdns", text))
    (r,) = good.collect()
    assert (r.target, r.hostname, r.attributes["service_name"], r.attributes["port"], r.confidence) == ("10.0.0.3", "cam.local", "Front Cam", "554", 0.6)
    assert bad.count() == 3
    assert [(a.kind, a.value) for a in captures.anchors_of(good, "capture_id").orderBy("seq").collect()] == [("hostname", "cam.local"), ("ip", "10.0.0.3")]
    assert '"attr_port":"554"' in captures.observations_of(good).first().payload


def test_scans(spark):
    ok = """<?xml version="1.0"?><!DOCTYPE nmaprun><nmaprun><host starttime="5" endtime="1714564800"><status state="up"/><address addr="10.0.0.1" addrtype="ipv4"/><address addr="AA:BB:CC:00:00:01" addrtype="mac" vendor="Acme"/>
    <hostnames><hostname name="h1"/></hostnames><ports><port protocol="tcp" portid="22"><state state="open"/><service name="ssh" product="OpenSSH" version="8.9p1" conf="10"/></port>
    <port protocol="tcp" portid="23"><state state="closed"/></port><port protocol="tcp" portid="70000"><state state="open"/></port><port protocol="tcp" portid="80"><state state="open"/></port></ports></host></nmaprun>"""
    rows = [(1, ok), (2, "<nmaprun><runstats><finished time='7'/></runstats></nmaprun>"), (3, ""), (4, "<other/>"), (5, ok[:200]), (6, '<!DOCTYPE x [<!ENTITY a "b">]><nmaprun></nmaprun>'), (7, None)]
    hosts, bad = scans.read_scans(spark.createDataFrame(rows, "scan_id long, xml string"))
    got = {r.scan_id: r for r in hosts.collect()}
    assert set(got) == {1, 2} and got[1].host_up and not got[2].host_up and list(got[2].ports) == []
    assert (got[1].mac, got[1].vendor, got[1].hostname) == ("aa:bb:cc:00:00:01", "Acme", "h1") and [(p.port, p.product, p.confidence) for p in got[1].ports] == [(22, "OpenSSH", 1.0), (80, None, 0.3)]
    assert {r.scan_id for r in bad.collect()} == {3, 4, 5, 6, 7}
    from pyspark.sql import functions as F

    kinds = scans.scan_observations(hosts.withColumn("address", F.lit("10.0.0.1"))).collect()
    assert {(r.scan_id, r.observation_type) for r in kinds} == {(1, "identity"), (1, "open_ports"), (1, "software")}


def test_packages(spark):
    dpkg = "Desired=Unknown\nii  libc6:amd64  2.35-0ubuntu3  amd64  GNU\nrc  old  1.0  all x\nhi  held  2.0 all y\niU half 1 all z"
    rpm = "openssl-libs-3.0.7-24.el9.x86_64\njunk\nbash-5.1.8-6.el9.x86_64"
    release = 'NAME="Ubuntu Linux"\nID=ubuntu\nVERSION_ID="22.04"\n# c\nbad line'
    rows = [(1, release, "Linux 5.15", dpkg, rpm), (2, None, "Linux 5.15 smp", None, ""), (3, None, None, None, None)]
    good, bad = scans.inspect(spark.createDataFrame(rows, "device_id long, os_release string, kernel string, dpkg string, rpm string"))
    got = [(r.device_id, r.name, r.version) for r in good.orderBy("device_id", "seq").collect()]
    assert got == [(1, "ubuntu", "22.04"), (1, "libc6", "2.35-0ubuntu3"), (1, "held", "2.0"), (1, "openssl-libs", "3.0.7-24.el9"), (1, "bash", "5.1.8-6.el9"), (2, "Linux", "5.15 smp")]
    assert [r.device_id for r in bad.collect()] == [3]


def test_inventory(spark, tmp_path):
    long = "x" * 500
    lines = [
        "﻿Asset ID,Device Name,S/N,MAC Address,IP,Owner,Site", "1,HOST-1.,SN 1,AA-BB-CC-00-00-01,10.0.0.1,ana,=cmd()", ",,,,,,", "2,=evil(),,nope,10.0.0.999,bob,", "2,host-2,SN2,,,,x",
        "2,host-2b,,,,,", ",host-3,,,,,", f"4,host-4,,,,{long},", "5,h5,,aabbcc000005,,,",
    ]
    (tmp_path / "f.csv").write_text("\n".join(lines), encoding="utf-8")
    m = inventory.Mapping("Asset ID", hostname="Device Name", serial="S/N", mac="MAC Address", ip="IP", owner="Owner", extras={"site": "Site"})
    rows = inventory.read_csv(spark, str(tmp_path / "f.csv"), m)
    good, bad = inventory.managed_records(rows, m)
    got = {r.external_id: r for r in good.collect()}
    assert got["1"].hostname == "host-1" and got["1"].serial is None and got["1"].mac == "aa:bb:cc:00:00:01" and got["1"].attributes == {"site": "'=cmd()"}
    assert got["2"].hostname == "host-2" and got["5"].mac == "aa:bb:cc:00:00:05"
    assert {r.row_number: r.reason for r in bad.collect()} == {3: "blank", 4: "no_identity", 6: "duplicate_external_id", 7: "no_external_id", 8: "oversized"}
    assert good.count() + bad.count() == len(lines) - 1
    with pytest.raises(ValueError, match="columns not in the file"):
        inventory.read_csv(spark, str(tmp_path / "f.csv"), inventory.Mapping("Nope"))


def test_cves(spark):
    page = """{"totalResults": 3, "vulnerabilities": [
      {"cve": {"id": "cve-2024-1", "published": "2024-01-02T03:04:05.000", "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": " hello "}],
        "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 99}}], "cvssMetricV30": [{"cvssData": {"baseScore": 9.8, "vectorString": "CVSS:3.0/x", "baseSeverity": "CRITICAL"}}]},
        "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": true, "criteria": "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "versionEndExcluding": "2.0"}, {"criteria": "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "versionEndExcluding": "2.0"}, {"vulnerable": false, "criteria": "cpe:2.3:o:x:y:-"}, {"criteria": "junk"}]}]}],
        "references": [{"url": "https://a.example/1"}, {"url": "ftp://b"}, "x"]}},
      "text", {"nope": 1}, {"cve": {"id": "GHSA-1"}}]}"""
    docs = [(1, page), (2, '{"totalResults": 0}'), (3, '{"other": 1}'), (4, '{"vulnerabilities": {}}'), (5, "not json")]
    good, bad = feeds.read_cves(spark.createDataFrame(docs, "document_id long, json string"))
    (r,) = good.collect()
    assert (r.cve_id, r.description, r.cvss_score, r.cvss_version, r.severity) == ("CVE-2024-1", "hello", 9.8, "3.0", "critical") and r.published_at == datetime(2024, 1, 2, 3, 4, 5)
    assert [(c.criteria, c.end_excluding, c.vulnerable) for c in r.cpe_matches] == [("cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "2.0", True), ("cpe:2.3:o:x:y:-", None, False)] and list(r.references) == ["https://a.example/1"]
    assert sorted((x.document_id, x.pos is None) for x in bad.collect()) == [(1, False)] * 3 + [(3, True), (4, True), (5, True)]
    assert feeds.criteria_of(good).count() == 2


def test_kev(spark):
    doc = '{"vulnerabilities": [{"cveID": "CVE-2024-1", "dateAdded": "2024-01-02", "knownRansomwareCampaignUse": "Known"}, {"cveID": "cve-2024-1"}, {"cveID": "x"}, "s", {"cveID": "CVE-2024-2", "dateAdded": "soon", "knownRansomwareCampaignUse": 3}]}'
    good, bad = feeds.read_kev(spark.createDataFrame([(1, doc), (2, "[]"), (3, '{"a": 1}')], "document_id long, json string"))
    got = {r.cve_id: (r.known_ransomware, r.date_added) for r in good.collect()}
    assert got == {"CVE-2024-1": (True, datetime(2024, 1, 2)), "CVE-2024-2": (None, None)} and bad.count() == 4


def test_epss(spark):
    text = "#model_version:v2024.1,score_date:2024-05-01T00:00:00+0000\ncve,epss,percentile\nCVE-2024-1,0.5,0.9\nbad,0.1,0.1\nCVE-2024-2,NaN,0.1\nCVE-2024-3,1.5,0.1\nCVE-2024-4,,\nCVE-2024-5,-0.1,0\nCVE-2024-6,1e-3,x"
    good, bad = feeds.read_epss(spark.createDataFrame([(1, text), (2, "a,b\n1,2"), (3, "cve,epss")], "document_id long, text string"))
    assert {(r.cve_id, r.score, r.percentile, r.model_version) for r in good.collect()} == {("CVE-2024-1", 0.5, 0.9, "v2024.1"), ("CVE-2024-6", 0.001, None, "v2024.1")}
    assert bad.filter("pos is not null").count() == 5 and bad.filter("pos is null").count() == 2


def test_workbook(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Name</t></is></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="str"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'
    for name, body in (("good.xlsx", sheet), ("bad.xlsx", '<!DOCTYPE a [<!ENTITY b "c">]>' + sheet)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Id</t></si><si><t>Host-1</t></si></sst>")
            z.writestr("xl/worksheets/sheet1.xml", body)
    m = inventory.Mapping("Id", hostname="Name")
    good, bad = inventory.managed_records(inventory.read_xlsx(spark, str(tmp_path / "good.xlsx"), m), m)
    assert [(r.external_id, r.hostname) for r in good.collect()] == [("7", "host-1")] and [(r.row_number, r.reason) for r in bad.collect()] == [(3, "no_identity")]
    with pytest.raises(ValueError, match="refused"):
        inventory.read_xlsx(spark, str(tmp_path / "bad.xlsx"), m)


def test_bounds_are_parameters_and_cuts_are_named(spark):
    cve = {"cve": {"id": "CVE-2024-1", "references": [{"url": f"https://x.example/{i}"} for i in range(60)], "configurations": [{"nodes": [{"cpeMatch": [{"criteria": f"cpe:2.3:a:v:p{i}:*", "vulnerable": True} for i in range(520)]}]}]}}
    docs = spark.createDataFrame([("d", json.dumps({"vulnerabilities": [cve]}))], "document_id string, json string")
    good, refused = feeds.read_cves(docs)
    row = good.first()
    assert (len(row.cpe_matches), len(row.references)) == (500, 50) and sorted(r.reason for r in refused.collect()) == ["50 of 60 references read", "500 of 520 criteria read"]
    good, refused = feeds.read_cves(docs, max_criteria=None, max_references=None)
    assert (len(good.first().cpe_matches), len(good.first().references)) == (520, 60) and not refused.count()
    device = spark.createDataFrame([(1, None, None, "\n".join(f"ii  p{i}  1.{i}  amd64" for i in range(9)), None)], "device_id long, os_release string, kernel string, dpkg string, rpm string")
    good, refused = scans.inspect(device, max_components=4)
    assert good.count() == 4 and [r.reason for r in refused.collect()] == ["a package list is longer than what is read of it"]
    good, refused = scans.inspect(device, max_lines=None, max_components=None)
    assert good.count() == 9 and not refused.count()


def test_gzipped_scores(spark, tmp_path):
    text = "#model_version:v2025.03.14,score_date:2025-06-01T00:00:00+0000\ncve,epss,percentile\nCVE-2024-1,0.5,0.9\nCVE-2024-2,1.5,0.9\n"
    with gzip.open(tmp_path / "scores.csv.gz", "wt") as f:
        f.write(text)
    good, refused = feeds.read_epss(feeds.epss_files(spark, str(tmp_path)))
    assert [(r.cve_id, r.score, r.model_version) for r in good.collect()] == [("CVE-2024-1", 0.5, "v2025.03.14")] and refused.count() == 1
