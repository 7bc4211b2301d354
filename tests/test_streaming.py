"""Streams give what the same rows give as a batch."""

from skyloom.operators import vectors as V
from skyloom.operators import gridding as G
from skyloom.sources import tables as T
from skyloom.operators import logs
from skyloom.streaming import gridder, pairing
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def run(stream, name):
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streamed_grid_equals_batch(spark, tmp_path):
    vis = T.visibilities(spark, SF)
    vis.repartition(3).write.parquet(str(tmp_path / "vis"))
    stream = spark.readStream.schema(vis.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "vis"))
    run(gridder.grid_stream(stream, 64, 8), "sums")
    gcf = T.convolution_table(spark)
    got = {tuple(r) for r in gridder.convolve(spark.table("sums"), gcf).select("x", "y", "gre", "gim", "n").collect()}
    want = G.grid(G.in_bounds(G.pregrid(vis, 64, 8), 64, 8), gcf, 8)
    assert got == {tuple(r) for r in want.select("x", "y", "gre", "gim", "n").collect()}


def test_windowed_rates(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    run(gridder.kernel_rates(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))), "rates")
    got = {(r["window"]["start"], r["event_type"], r["n"]) for r in spark.table("rates").collect()}
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()
    assert got == {(r["w"]["start"], r["event_type"], r["n"]) for r in want}


def test_fold_and_chunks(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert df.select(V.fold(F.col("a"), F.lit(0), lambda s, x: s * 10 + x)).first()[0] == 123
    assert [r["chunk"] for r in V.chunks(spark.range(7), "id", 3).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_paired_out_of_order(spark, tmp_path):
    """Lines that arrive in any order within the watermark's delay are paired as the whole log is; what finds no partner goes alone."""
    import datetime as dt
    import random

    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(200):
        at = t0 + dt.timedelta(seconds=30 * i)
        rows += [(at, i % 3, "START", "k"), (at + dt.timedelta(seconds=rng.randrange(5, 200)), i % 3, "END", "k")]
    rows.append((t0 + dt.timedelta(seconds=1), 9, "START", "lost"))
    arrival = sorted(rows, key=lambda r: (r[0] - t0).total_seconds() + rng.random() * 240)  # up to four minutes late
    schema = "ts timestamp, pid long, tag string, msg string"
    folder = tmp_path / "lines"
    parts = [arrival[i : i + 67] for i in range(0, len(arrival), 67)] + [[(t0 + dt.timedelta(hours=h), 0, "RAW", "")] for h in (9, 10)]
    parts[-2].append((t0 + dt.timedelta(hours=9), 7, "START", "end of log"))
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"p{i}"))
    (tmp_path / "in").mkdir()
    for i in range(len(parts)):  # one file after the other, by name and time
        source = next((folder / f"p{i}").glob("part-*.parquet"))
        source.rename(tmp_path / "in" / f"{i:03d}.parquet")
        import os

        os.utime(tmp_path / "in" / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pairing.pair_stream(stream, "10 minutes", "1 hour").writeStream.outputMode("append").format("memory").queryName("calls").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.table("calls").filter("msg = 'k'").collect())
    batch = spark.createDataFrame(rows, schema).filter("msg = 'k'").withColumn("attrs", F.lit(None).cast("map<string,double>"))
    want = sorted(tuple(r) for r in logs.pair(batch).select("pid", "msg", "occurrence", "start", "stop").collect())
    assert got == want and len(got) == 200
    assert [tuple(r) for r in spark.table("calls").filter("msg = 'lost'").collect()] == [(9, "lost", 1, t0 + dt.timedelta(seconds=1), None)]
