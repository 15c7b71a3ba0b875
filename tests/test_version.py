"""Version order and ranges: the documented oddities, and parity with a plain statement of the rules."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harborlight.functions.version import compare_versions, parse_cpe, version_in_range

EARLY = {"alpha", "a", "beta", "b", "rc", "pre", "dev", "snapshot"}


def plain(left, right):
    def cut(v):
        t = re.findall(r"[0-9]+|[a-z]+", v.strip().lower())
        return t if any(x.isdigit() for x in t) else None

    a, b = cut(left), cut(right)
    if a is None or b is None:
        return "unknown"
    for i in range(max(len(a), len(b))):
        x, y = (t[i] if i < len(t) else None for t in (a, b))
        if x == y:
            continue
        if x is None or y is None:
            early = (y if x is None else x) in EARLY
            return ("greater" if early else "less") if x is None else ("less" if early else "greater")
        if x.isdigit() and y.isdigit():
            return "less" if int(x) < int(y) else "greater"
        if x.isdigit():
            return "greater" if y in EARLY else "less"
        if y.isdigit():
            return "less" if x in EARLY else "greater"
        return "less" if x < y else "greater"
    return "equal"


CASES = [
    ("1.0rc1", "1.0", "less"), ("1.0", "1.0p1", "less"), ("1.0rc1", "1.0p1", "greater"),  # not transitive
    ("1.01", "1.1", "greater"), ("1.1", "1.01", "greater"),  # not antisymmetric
    ("8.9.1", "8.9p1", "less"), ("1.0.2a", "1.0.2", "less"), ("1.0", "1.0.0", "less"), ("1:8.9p1", "8.9p1", "less"),
    ("2.4.9", "2.4.10", "less"), ("10.0", "9.9", "greater"), ("1.0", "1.0", "equal"), ("latest", "1.0", "unknown"), ("", "1", "unknown"), ("*", "1", "unknown"),
    ("99999999999999999999999.1", "99999999999999999999998.1", "greater"), ("1.0-beta", "1.0-alpha", "greater"),
]


def test_order(spark):
    rows = spark.createDataFrame(CASES, "l string, r string, want string").withColumn("got", compare_versions(F.col("l"), F.col("r"))).collect()
    assert [r for r in rows if r.got != r.want] == []
    assert all(plain(left, right) == want for left, right, want in CASES)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(*[st.from_regex(r"\A[0-9a-c.rcp-]{0,8}\Z")] * 2), min_size=40, max_size=80))
def test_order_like_plain_rules(spark, pairs):
    rows = spark.createDataFrame(pairs, "l string, r string").withColumn("got", compare_versions(F.col("l"), F.col("r"))).collect()
    assert [(r.l, r.r, r.got, plain(r.l, r.r)) for r in rows if r.got != plain(r.l, r.r)] == []


RANGES = [
    ("2.4.57", None, None, None, "2.4.58", "in_range"), ("2.4.58", None, None, None, "2.4.58", "out_of_range"), ("2.4.58", None, None, "2.4.58", None, "in_range"),
    ("1.0", None, "1.0", None, None, "out_of_range"), ("1.0", "1.0", None, None, None, "in_range"), (None, None, None, None, None, "in_range"), (None, "1", None, None, None, "inconclusive"),
    ("1.0", "latest", None, "0.5", None, "inconclusive"), ("1.0", "2.0", None, "latest", None, "out_of_range"), ("1.0", "", None, "", None, "in_range"), ("latest", None, None, None, None, "in_range"),
]


def test_ranges(spark):
    cols = ["v", "si", "sx", "ei", "ex"]
    df = spark.createDataFrame(RANGES, ", ".join(f"{c} string" for c in [*cols, "want"]))
    rows = df.withColumn("got", version_in_range(*map(F.col, cols))).collect()
    assert [r for r in rows if r.got != r.want] == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"cpe:2.3:a:V:pro\:d:1.0:*:*:*:*:*:*:*", ("a", "v", "pro:d", "1.0")),
        (" CPE:2.3:o:v:p:- ", ("o", "v", "p", "-")),
        ("cpe:2.3:a:v:p", None),
        ("cpe:/a:v:p:1", None),
        (None, None),
    ],
)
def test_cpe(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_cpe(F.col("t")).alias("c")).first().c
    assert (None if got is None else tuple(got)) == want
