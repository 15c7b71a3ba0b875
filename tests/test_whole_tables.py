"""Queries over whole tables against brute force, besides their SQL."""

import collections
import datetime
import hashlib
import json

from harborlight import catalog
from harborlight.plans.fixtures import table, view
from tests.test_version import plain

QUERIES = catalog.queries()


def test_version_order_over_all_pairs(spark, data):
    rows = QUERIES["version_order"](spark, data).collect()
    versions = {r.left_version for r in rows}
    assert len(rows) == len(versions) ** 2 == len({(r.left_version, r.right_version) for r in rows})
    assert [r for r in rows if r.ordering != plain(r.left_version, r.right_version)] == []


def test_interval_join_of_all_openers(spark, data):
    by, want = collections.defaultdict(list), set()
    for r in table(spark, data, "events").select("event_id", "user_id", "ts").collect():
        by[r.user_id].append(r)
    for rows in by.values():
        want |= {(a.event_id, b.event_id) for a in rows for b in rows if b.ts <= a.ts < b.ts + datetime.timedelta(hours=6)}
    got = [tuple(r) for r in QUERIES["interval_join"](spark, data).collect()]
    assert len(got) == len(want) and set(got) == want


def test_spine_of_all_types(spark, data):
    rows = sorted(view(spark, data, "v_observation").collect(), key=lambda r: r.observation_id)
    key = lambda r: (r.tenant_id, r.run_id, r.source_identifier or "", r.observation_type, digest(r.payload))
    digest = lambda p: hashlib.sha256(json.dumps(json.loads(p), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    seen, want = {key(r) for r in rows if r.observation_id % 10 == 7}, []
    for r in rows:
        if r.observation_id % 10 != 7:
            want.append((r.observation_id, digest(r.payload), key(r) not in seen))
            seen.add(key(r))
    assert len({r.observation_type for r in rows}) == 8
    assert sorted(tuple(r) for r in QUERIES["spine_created"](spark, data).collect()) == want
