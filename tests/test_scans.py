"""Two-level scans, and what is made of them, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import logs as L
from skyloom.operators import regions as R
from skyloom.operators.scans import Running, bounds, bucket_of, scan
from skyloom.sources import tables as T


def test_scan_equals_a_loop(spark):
    """A hot key, null keys and nulls of the order and the value."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(40)]), i, rng.choice([None, 1, 5, 9])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, i int, v int")
    states = {"n": Running("count"), "before": Running("sum", F.col("v"), own=False), "top": Running("max", F.col("v")), "last": Running("last", F.col("v"))}
    got = {r.i: (r.n, r.before, r.top, r.last) for r in scan(df, ["k"], ["at", "i"], **states).collect()}
    for key in ("hot", "b", None):
        n, total, top, last = 0, 0, None, None
        for _, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            n, before = n + 1, total
            if v is not None:
                total, top, last = total + v, max(top or 0, v), v
            assert got[i] == (n, before, top, last)
    assert len(got) == len(rows)
    assert scan(df.limit(0), ["k"], ["at"], n=Running("count")).count() == 0


def test_buckets_bound_every_task(spark):
    df = spark.range(10_000).withColumn("k", F.lit(1))
    inner = bounds(df, "id", 20)
    sizes = [r[1] for r in df.groupBy(bucket_of(F.col("id"), inner)).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 700


def test_pairs_with_ties(spark):
    rows = [(5, 1, t, {"a": float(x)}, "m") for t, x in (("START", 2), ("START", 1), ("END", 1), ("END", 2))] + [(9, 1, "START", None, "m"), (9, 2, "END", {}, "m")]
    got = L.pair(spark.createDataFrame(rows, "ts long, pid long, tag string, attrs map<string,double>, msg string"))
    assert sorted(tuple(r) for r in got.select("pid", "occurrence", "start", "stop", F.col("start_attrs")["a"], F.col("end_attrs")["a"]).collect()) == [
        (1, 1, 5, 5, 1.0, 1.0), (1, 2, 5, 5, 2.0, 2.0), (1, 3, 9, None, None, None), (2, 1, None, 9, None, None),
    ]


def test_busy_and_merged(spark):
    calls = spark.createDataFrame([("a", 0, 4), ("a", 6, 7), ("b", 1, 2), ("a", 9, 9)], "row string, start long, stop long")
    assert sorted(tuple(r) for r in L.busy_timeline(calls, "row").collect()) == [("a", 0, 4, 0), ("a", 6, 7, 4), ("a", 9, 9, 5), ("b", 1, 2, 0)]
    rng = random.Random(4)
    rows = [(rng.choice("xxxy"), lo, lo + rng.randrange(1, 30)) for lo in (rng.randrange(2000) for _ in range(300))]
    got = sorted(tuple(r) for r in R.merge_ranges(spark.createDataFrame(rows, "k string, lo int, hi int"), "k").collect())
    want = []
    for k in "xy":
        for _, lo, hi in sorted(r for r in rows if r[0] == k):
            if want and want[-1][0] == k and lo <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(hi, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((k, lo, hi, 1))
    assert got == sorted(want)


@pytest.mark.parametrize("literal", [1000, 0])
def test_as_of_both_ways(spark, literal):
    points = spark.createDataFrame([(i, at) for i, at in enumerate([None, -5.0, 0.0, 3.5, 4.0, 99.0] * 30)], "i int, at double")
    steps = spark.createDataFrame([(0, "z"), (4, "f"), (50, None)], "step int, name string")
    want = {None: (None, None), -5.0: (None, None), 0.0: (0, "z"), 3.5: (0, "z"), 4.0: (4, "f"), 99.0: (50, None)}
    got = R.as_of(points, steps, "at", "step", literal)
    assert got.columns == ["i", "at", "step", "name"] and got.count() == 180
    assert all((r.step, r.name) == want[r.at] for r in got.collect())
    ranges = spark.createDataFrame([(0, 2, "z"), (4, 5, "f")], "lo int, hi int, name string")
    held = {r.at: (r.lo, r.hi, r.name) for r in R.in_range(points, ranges, "at", literal).collect()}
    assert held == {None: (None,) * 3, -5.0: (None,) * 3, 0.0: (0, 2, "z"), 3.5: (None,) * 3, 4.0: (4, 5, "f"), 99.0: (None,) * 3}
    assert R.as_of(points, steps.limit(0), "at", "step", literal).filter("step is not null").count() == 0


def test_text_log_keeps_its_order(spark, tmp_path):
    """Messages split over lines far apart, in a file that many tasks read."""
    lines = [f"{i}: start [[{i}]]" for i in range(300)] + [f"[[{i}]] middle [[{i}]]" for i in range(300)] + ["plain"] + [f"[[{i}]] end" for i in range(300)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = T.read_log(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 5
        assert [r.value for r in read.orderBy("log", "block", "line").collect()] == lines
        glued = L.glue(read, ("block", "line")).orderBy("at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in glued] == [f"{i}: start  middle  end" for i in range(300)] + ["plain"]


def test_names_and_launches(spark):
    named = spark.createDataFrame([("GridKernelCPU",), ("gridKernelCPU",), ("DegridKernelCPU",), ("ridKernelCPU",), ("",)], "msg string")
    assert [r.msg for r in L.named_past_first(named, "ridKernelCPU").collect()] == ["GridKernelCPU", "gridKernelCPU"]
    lines = spark.createDataFrame(
        [(1, 0, 'x capset 1: args: ["no"]'), (1, 1, 'capset 1: args: ["a","b c",""]'), (1, 2, 'capset 1: args: ["later"]'), (1, 3, 'capset 12: env: ["A=1","=2","B=x=y","é=1","A=3","bad"] end'), (2, 0, 'capset 1: args: []')],
        "log int, at int, value string",
    )
    assert [tuple(r) for r in L.program_args(lines).collect()] == [(1, ["a", "b c", ""])]
    assert [tuple(r) for r in L.program_env(lines).collect()] == [(1, {"A": "3", "B": "x=y", "é": "1"})]
