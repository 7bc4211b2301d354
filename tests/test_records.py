"""Flat-record files: byte ranges, whole records, order and axes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.sources import records


def test_round_trip_by_byte_ranges(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") * 0.5).alias("a"), (-F.col("id")).cast("double").alias("b")).repartition(7)
    records.write_records(rows, path, ["a", "b"], "i", 300)
    assert sorted(os.listdir(path)) == [f"part-{k:010d}.bin" for k in range(4)]
    assert np.fromfile(f"{path}/part-0000000003.bin", "<f8").tolist() == [x for i in range(900, 1000) for x in (i / 2, -i)]
    back = records.read_records(spark, path, ["a", "b"], span=160)
    assert back.rdd.getNumPartitions() == 3 * 30 + 10
    got = {(r.file, r.row): (r.a, r.b) for r in back.collect()}
    assert got == {(f"part-{i // 300:010d}.bin", i % 300): (i / 2, -float(i)) for i in range(1000)}


def test_kinds_and_broken_files(spark, tmp_path):
    np.arange(6, dtype="<i4").tofile(tmp_path / "six")
    assert [(r.row, r.x, r.y) for r in records.read_records(spark, str(tmp_path / "six"), ["x", "y"], "int").orderBy("row").collect()] == [(0, 0, 1), (1, 2, 3), (2, 4, 5)]
    with pytest.raises(Exception, match="whole records"):
        records.read_records(spark, str(tmp_path / "six"), ["a", "b", "c", "d"], "int").count()


def test_axes(spark):
    shape, axes = [3, 4, 5, 2], [2, 0, 3, 1]
    got = {r.id: r.to for r in spark.range(120).select("id", records.permuted(F.col("id"), shape, axes).alias("to")).collect()}
    moved = np.arange(120).reshape(shape).transpose(axes).ravel()
    assert all(got[int(cell)] == place for place, cell in enumerate(moved))
