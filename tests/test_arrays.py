"""Vectors, regions and logs on small cases."""

import math
from itertools import combinations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.operators import binning as B
from skyloom.operators import logs as L
from skyloom.operators import regions as R
from skyloom.operators import vectors as V
from skyloom.plans import arrays


def test_dot_of_generated_vectors(spark):
    n = 1000
    got = V.dot(V.generate(spark, n, lambda i: i.cast("double")), V.generate(spark, n, lambda i: F.lit(0.1))).first()[0]
    assert math.isclose(got, 0.1 * n * (n - 1) / 2)


def test_recovered_dot_drops_a_slice(spark):
    parts = spark.createDataFrame([(0, 1.0), (2, 3.0)], "rank int, s double")
    whole = R.recover(spark.range(4).select(F.col("id").cast("int").alias("rank")), parts, {"s": F.lit(0.0)}, "rank")
    assert sorted(map(tuple, whole.collect())) == [(0, 1.0), (1, 0.0), (2, 3.0), (3, 0.0)]


def test_newton_sqrt(spark):
    got = spark.createDataFrame([(9.806,), (0.0,), (1e-8,), (1e12,)], "x double").select("x", V.newton_sqrt(F.col("x")).alias("r")).collect()
    assert all(math.isclose(r["r"], math.sqrt(r["x"]), rel_tol=1e-9) for r in got)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 5))
def test_linear_partition_is_optimal(values, k):
    got = V.linear_partition(list(enumerate(map(float, values))), k)
    assert got == sorted(got) and len(got) == len(values)
    worst = max(sum(v for v, g in zip(values, got) if g == p) for p in set(got))
    best = min(max(sum(values[a:b]) for a, b in zip((0, *c), (*c, len(values)))) for c in combinations(range(1, len(values)), min(k, len(values)) - 1))
    assert worst == best


def test_running_total_across_ranges(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(0, 100, 3)], "i long, x int")
    got = {r["i"]: r["total"] for r in V.running_total(df, "i", "x", 16).collect()}
    assert all(got[i] == sum(j % 5 for j in range(0, i + 1, 3)) for i in got)


def test_spans_and_shares(spark):
    work = spark.createDataFrame([(0, 8), (1, 8), (2, 5), (3, 5)], "i int, n long")
    got = R.least_span(work, "n", 16).orderBy("i").collect()
    assert [r["nodes"] for r in got] == [5, 5, 3, 3] and {r["span"] for r in got} == {5 / 3}
    items = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0)], "i int, w double")
    assert [r["n"] for r in R.shares(items, "i", "w", 10).orderBy("i").collect()] == [2, 3, 5]


def test_range_split_covers(spark):
    lo, hi = R.range_split(3, 20, 4, F.col("id"))
    assert [tuple(r) for r in spark.range(4).select(lo, hi).collect()] == [(3, 7), (7, 11), (11, 15), (15, 20)]


def test_dense_tiles(spark):
    s = spark.createDataFrame([(10 * n, 100 + n) for n in range(100)], "x int, v int")
    got = {r["x"]: r["v"] for r in B.densify(s, 1000, 50).collect()}
    assert len(got) == 1000 and got[10] == 101 and got[11] == 0


def test_margin_copies(spark):
    p = spark.createDataFrame([(1.0, 32.0), (63.0, 63.5), (32.0, 32.0)], "u double, v double")
    got = B.with_margin(p, 64, 4).collect()
    tiles = sorted((r["u"], r["tile_u"], r["tile_v"]) for r in got)
    assert tiles == [(1.0, -1, 0), (1.0, 0, 0), (32.0, 0, 0), (63.0, 0, 0), (63.0, 0, 1), (63.0, 1, 0), (63.0, 1, 1)]
    assert sum(r["home"] for r in got) == 3


def test_log_lines(spark):
    lines = ["12: cap 3: START [hint=5] [io=2] kern a", "90: cap 3: END [io=7] kern a", "nonsense", "95: cap 3: END kern a"]
    entries = L.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["tag"] for r in entries.collect()] == ["START", "END", "RAW", "END"]
    pairs = L.differences(L.pair(entries), "io", "hint").orderBy("occurrence").collect()
    assert [(r["start"], r["stop"], r["io"], r["hint"]) for r in pairs] == [(12, 90, 5.0, -5.0), (None, 95, 0.0, 0.0)]


def test_split_messages_are_glued(spark):
    rows = [("n", 1, "1: cap 0: START long[[7]]"), ("n", 2, "2: cap 0: other"), ("n", 3, "[[7]]er mess[[7]]"), ("n", 4, "[[7]]age"), ("n", 5, "5: again[[7]]"), ("n", 6, "[[7]] too")]
    got = L.glue(spark.createDataFrame(rows, "log string, at long, value string")).orderBy("at").collect()
    assert [r["value"] for r in got] == ["1: cap 0: START longer message", "2: cap 0: other", "5: again too"]


def test_clocks_keep_their_offsets(spark):
    logs = spark.createDataFrame([(1, 100), (1, 140), (2, 130)], "pid int, ts long")
    assert sorted(map(tuple, L.align_clocks(logs).select("pid", "ts").collect())) == [(1, 0), (1, 40), (2, 30)]
    assert L.align_clocks(logs.limit(0)).count() == 0


def test_attribute_families(spark):
    lines = spark.createDataFrame([("[hint:ops=1] [hint:ops=2] [perf:sse=3/40] [tag=word] ",), ("",)], "a string").select(L.text_attributes(F.col("a")).alias("m"))
    got = [[tuple(x) for x in r[0]] for r in lines.select(L.counter_families(F.col("m"))).collect()]
    assert got == [[("hint", "ops", 2.0, None), ("perf", "sse", 3.0, 40.0), (None, "tag", None, None)], []]


def test_error_classes(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.05), (1.0, 1.2), (3.0, 1.0), (1.0, None)], "v double, h double")
    assert [r[0] for r in df.select(L.error_class("v", "h")).collect()] == ["hint", "ok", "warning", "error", "none"]


def folded(spark, tmp_path, embeddings):
    """a2_fold's rows over embeddings of 32-bit floats, and a call that gives its SQL's."""
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(list(enumerate(embeddings)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    return arrays.a2_fold(spark, str(tmp_path)), lambda: con.execute(arrays.ORACLE_SQL["a2_fold"]).fetchall()


def test_fold_multiplies_floats_as_floats(spark, tmp_path):
    """Some thousandths lie under their whole number as doubles and on it as floats."""
    got, want = folded(spark, tmp_path, [[i / 1000] for i in range(-600, 600)] + [[0.123, 0.249], [-0.0, -0.5004], [9.2e15, -9.2e15], [-9223372036854776.0], [9e15, 9e15, -9e15]])
    assert sorted(map(tuple, got.collect())) == sorted(want())


def test_fold_of_nulls(spark, tmp_path):
    got, want = folded(spark, tmp_path, [None, [], [None], [1.5, None], [None, 2.25, None, -0.25], [1.0]])
    assert sorted(map(tuple, got.collect())) == sorted(want()) == [(0, None), (1, None), (2, None), (3, 1500), (4, 2000), (5, 1000)]


@pytest.mark.parametrize("x", [math.nan, math.inf, -math.inf, 9.3e15, 3e38])
def test_fold_without_whole_number_fails(spark, tmp_path, x):
    got, want = folded(spark, tmp_path, [[1.0, x]])
    with pytest.raises(duckdb.ConversionException):
        want()
    with pytest.raises(Exception, match="no 64-bit whole number"):
        got.collect()


def test_fold_over_64_bits_fails(spark, tmp_path):
    got, _ = folded(spark, tmp_path, [[9e15, 9e15]])
    with pytest.raises(Exception, match="OVERFLOW"):
        got.collect()
