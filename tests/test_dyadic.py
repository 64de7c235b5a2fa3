"""Range joins and window aggregates over dyadic ranges against plain loops."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.operators import dyadic
from quarry.plans.queries_report import window_counts

ZERO = dt.datetime(2024, 1, 1)
UNIT = dt.timedelta(microseconds=1 << dyadic.UNIT_BITS)


def times(rng, n):
    """Times that are dense, far apart, before 1970, on units' ends, and none."""
    start = dt.datetime(1970, 1, 1)
    out = [ZERO + dt.timedelta(seconds=rng.randint(0, 600)) for _ in range(n)]
    out += [ZERO + dt.timedelta(days=rng.random() * 4000) for _ in range(n)]
    out += [start - dt.timedelta(days=rng.random() * 4000) for _ in range(n // 2)]
    for k in rng.sample(range(-10 ** 6, 3 * 10 ** 7), n // 4):
        out += [start + k * UNIT, start + k * UNIT - dt.timedelta(microseconds=1)]
    return out + [None] * 5


def windows(rng, rows, n):
    known = [t for t in rows if t]
    out = [(ZERO, ZERO), (ZERO, ZERO - dt.timedelta(1)), (known[0], known[0]),
           (ZERO, ZERO + dt.timedelta(days=3653)), (ZERO, ZERO + dt.timedelta(days=3653))]
    for _ in range(n):
        lo = rng.choice(known) + rng.choice([0, 0, 1, -1]) * dt.timedelta(microseconds=1)
        length = rng.choice([dt.timedelta(0), UNIT, dt.timedelta(seconds=rng.randint(0, 400)),
                             dt.timedelta(days=rng.random() * 3000), rng.choice(known) - lo])
        out.append((lo, lo + length))
    return [(f"w{i}", lo, hi) for i, (lo, hi) in enumerate(out)]


@pytest.fixture(scope="module", params=["broadcast", "shuffled"])
def case(spark, request):
    rng = random.Random(8)
    at = times(rng, 60)
    rows = [(i, t, rng.choice("abc"), f"p{rng.randint(0, 99):02d}-{i}", rng.randint(-5, 50), rng.choice([None, "x", "y"]))
            for i, t in enumerate(at)]
    wins = windows(rng, at, 70)
    files = spark.createDataFrame(rows, "n int, modified timestamp_ntz, kind string, path string, size bigint, tag string")
    frame = spark.createDataFrame(wins, "scope_id string, start_date timestamp_ntz, end_date timestamp_ntz")
    keep = dyadic.BROADCAST_BYTES, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "shuffled":
        dyadic.BROADCAST_BYTES = 0
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    inside = defaultdict(list)
    for w, lo, hi in wins:
        inside[w] = [r for r in rows if r[1] is not None and lo <= r[1] <= hi]
    yield files, frame, rows, inside
    dyadic.BROADCAST_BYTES = keep[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep[1])


def test_join_is_every_pair_once(case):
    files, frame, rows, inside = case
    got = dyadic.join(files, dyadic.selection(frame)).select("scope_id", "n").collect()
    assert Counter((r["scope_id"], r["n"]) for r in got) == Counter((w, r[0]) for w, some in inside.items() for r in some)


def test_semi_join_is_every_covered_row_once(case):
    files, frame, rows, inside = case
    few = ["w0", "w3", "w4", *[f"w{i}" for i in range(5, 30, 3)]]
    for names in (few, list(inside), ["w1"]):
        s = dyadic.selection(frame.where(F.col("scope_id").isin(*names)))
        got = dyadic.semi_join(files, s)
        assert got.columns == files.columns
        assert Counter(r["n"] for r in got.collect()) == Counter({r[0] for w in names for r in inside[w]})


def test_aggregates_merge_to_those_of_the_pairs(case, spark):
    files, frame, rows, inside = case
    s = dyadic.selection(frame, spark.range(1))
    got = dyadic.aggregate(files, s, {
        "rows": (F.lit(1).cast("bigint"), "sum"), "bytes": (F.col("size"), "sum"), "most": (F.col("size"), "max"),
        "least": (F.struct("path", "n"), "min"), "has_a": (F.col("kind") == "a", "any"), "tags": (F.col("tag"), "set")})
    want = {w: some for w, some in inside.items() if some} | {"all": rows}
    found = {r["scope_id"]: r for r in got.collect()}
    assert set(found) == set(want)
    for w, some in want.items():
        r = found[w]
        assert (r["rows"], r["bytes"], r["most"]) == (len(some), sum(x[4] for x in some), max(x[4] for x in some))
        assert tuple(r["least"]) == min((x[3], x[0]) for x in some)
        assert r["has_a"] == any(x[2] == "a" for x in some)
        assert r["tags"] == sorted({x[5] for x in some if x[5]})


def test_first_rows_merge_to_those_of_the_pairs(case, spark):
    files, frame, rows, inside = case
    s = dyadic.selection(frame, spark.range(1))
    got = dyadic.first_n(files.select("n", "path", "kind", "modified"), s, 3).collect()
    want = set()
    for w, some in (inside | {"all": rows}).items():
        for kind in "abc":
            best = sorted(x[3] for x in some if x[2] == kind)[:3]
            want |= {(w, kind, i + 1, p) for i, p in enumerate(best)}
    assert sorted((r["scope_id"], r["kind"], r["rank"], r["path"]) for r in got) == sorted(want)


def test_no_scopes_and_no_rows(spark):
    none = spark.createDataFrame([], "scope_id string, start_date timestamp_ntz, end_date timestamp_ntz")
    files = spark.createDataFrame([(ZERO, "a", "p", 1)], "modified timestamp_ntz, kind string, path string, size int")
    values = {"rows": (F.lit(1), "sum")}
    s = dyadic.selection(none)
    assert s.levels == [] and not s.has_all
    assert dyadic.join(files, s).count() == dyadic.semi_join(files, s).count() == 0
    assert dyadic.aggregate(files, s, values).count() == dyadic.first_n(files, s, 2).count() == 0
    s = dyadic.selection(none, spark.range(1))
    assert dyadic.aggregate(files, s, values).collect()[0]["rows"] == 1 and dyadic.semi_join(files, s).count() == 1
    some = dyadic.selection(spark.createDataFrame([("w", ZERO, ZERO)], none.schema))
    assert dyadic.aggregate(files.limit(0), some, values).count() == 0


def test_a_window_of_ten_years_has_tens_of_nodes(spark):
    rng = random.Random(3)
    lengths = [dt.timedelta(days=3653), dt.timedelta(hours=1), dt.timedelta(days=30), dt.timedelta(0)]
    rows = [(f"{i}-{k}", t, t + length) for i, length in enumerate(lengths)
            for k, t in enumerate(ZERO + dt.timedelta(seconds=rng.randint(0, 10 ** 8)) for _ in range(50))]
    nodes = dyadic.cover(spark.createDataFrame(rows, "scope_id string, start_date timestamp_ntz, end_date timestamp_ntz"))
    sizes = {r["scope_id"]: r["n"] for r in nodes.groupBy("scope_id").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 200
    for scope, n in sizes.items():
        assert n <= {"0": 46, "1": 14, "2": 32, "3": 1}[scope[0]]


def test_nodes_do_not_grow_with_files_and_pairs_are_not_formed(spark):
    """100 and 10,000 windows: the same aggregates as a loop, and no row per pair."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for n in (100, 10_000):
        df = window_counts(spark, SF_SMALL, n)
        got = df.collect()
        assert len(got) == n
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
        last = docs.agg(F.max("doc_id")).first()[0]
        if n == 100:
            few = {r["task_id"]: r for r in got}
        else:  # the windows that are the same in both
            many = {r["task_id"]: r for r in got}
            for i in range(100):
                if i * last // 100 == (i * 100) * last // 10_000:
                    assert tuple(many[f"W-{i * 100:03d}"])[1:] == tuple(few[f"W-{i:03d}"])[1:]
