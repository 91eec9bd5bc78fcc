"""Ordered operators on keys cut into buckets, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from facetide.operators.evaluation import class_index
from facetide.operators.ordered import BUCKET, FARTHEST, bucketed, last_known, numbered, running_count, trailing

SCHEMA = "k string, t double, n long, v string"


def make(seed=1, size=3000):
    """One key holds two thirds of the rows, one holds none of its own, many are small."""
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        key = "hot" if i % 3 else f"cold{rng.randrange(40)}"
        time = rng.choice([None, 7.0, round(rng.random() * 50, 1)]) if i % 5 == 0 else rng.random() * 100
        rows.append((None if i % 50 == 1 else key, time, i, rng.choice([None, "a", "b", "c"])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


def sort_key(row):
    return (row[1] is not None, row[1] or 0.0, row[2])


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=sort_key):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_buckets_follow_the_sort(frame, rows):
    parts = bucketed(frame, ["k"], ["t", "n"], 10.0)
    found = {r.n: r[BUCKET] for r in parts.rows.collect()}
    assert len(found) == len(rows)
    hot = [found[r[2]] for r in by_key(rows)["hot"]]
    assert hot == sorted(hot) and len(set(hot)) == 11  # one for missing times
    assert {r.k for r in bucketed(frame, ["k"], ["t", "n"], 1000.0).long_keys().collect()} >= {"hot"}
    assert bucketed(frame.where("t IS NOT NULL"), ["k"], ["t", "n"], 1000.0).long_keys().isEmpty()


def test_buckets_of_odd_values(spark):
    odd = spark.createDataFrame([(None,), (float("-inf"),), (-0.5,), (0.0,), (3.0,), (1e300,), (float("inf"),), (float("nan"),)], "t double")
    numbers = [r[BUCKET] for r in bucketed(odd, [], ["t"], 1.0).rows.orderBy("t").collect()]
    assert numbers == sorted(numbers) and [n - FARTHEST for n in numbers[2:5]] == [-1, 0, 3] and min(numbers) == 0 and len(set(numbers)) == 7
    days = spark.sql("SELECT DATE'2024-01-01' AS t UNION ALL SELECT DATE'2024-01-02'")
    assert len({r[BUCKET] for r in bucketed(days, [], ["t"]).rows.collect()}) == 2


@pytest.mark.parametrize("span", [None, 9.0, 0.7])
def test_running_count(frame, rows, span):
    counted = running_count(bucketed(frame, ["k"], ["t", "n"], span), "pos")
    want = {row[2]: i + 1 for group in by_key(rows).values() for i, row in enumerate(group)}
    assert {r.n: r.pos for r in counted.collect()} == want


@pytest.mark.parametrize("span", [None, 9.0])
def test_running_count_without_keys(frame, rows, span):
    counted = running_count(bucketed(frame, [], ["t", "n"], span), "pos")
    want = {row[2]: i + 1 for i, row in enumerate(sorted(rows, key=sort_key))}
    assert {r.n: r.pos for r in counted.collect()} == want


@pytest.mark.parametrize("span", [None, 9.0, 0.7])
def test_last_known(frame, rows, span):
    known = last_known(bucketed(frame, ["k"], ["t", "n"], span), "v", "newest")
    want = {}
    for group in by_key(rows).values():
        newest = None
        for row in group:
            newest = row[3] if row[3] is not None else newest
            want[row[2]] = newest
    assert {r.n: r.newest for r in known.collect()} == want


@pytest.mark.parametrize("rows_per_block", [10_000, 100, 20])
def test_trailing(frame, rows, rows_per_block):
    results = {"seen": lambda w: F.collect_list("n").over(w), "low": lambda w: F.min("n").over(w)}
    done = trailing(frame, ["k"], ["t", "n"], 15, results, rows_per_block=rows_per_block)
    want = {}
    for group in by_key(rows).values():
        numbers = [row[2] for row in group]
        for i, n in enumerate(numbers):
            window = numbers[max(0, i - 14) : i + 1]
            want[n] = (window, min(window))
    assert {r.n: (r.seen, r.low) for r in done.collect()} == want


def test_counts_on_timestamps(spark):
    start = dt.datetime(2024, 1, 1)
    moments = [("cam", start + dt.timedelta(microseconds=i * 1_000_003)) for i in range(1500)]
    frame = spark.createDataFrame(moments, "k string, at timestamp")
    counted = running_count(bucketed(frame, ["k"], ["at"], 64), "pos")
    found = [r.pos for r in counted.orderBy("at").collect()]
    assert found == list(range(1, 1501))


def test_numbered_by_ranges(spark):
    words = [f"w{i * 7919 % 3001:04}" for i in range(3001)]
    frame = spark.createDataFrame([(w,) for w in words], "w string").repartition(6)
    assert [r.pos for r in numbered(frame, ["w"], "pos").orderBy("w").collect()] == list(range(1, 3002))
    assert numbered(frame.where("false"), ["w"], "pos").collect() == []


def test_class_index_has_no_window_of_one_partition(spark):
    plan = class_index(spark.createDataFrame([("b",), ("a",), (None,)], "label string"))
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in plan.orderBy("idx").collect()] == [(0, "a"), (1, "b")]
