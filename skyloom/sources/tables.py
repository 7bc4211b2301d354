"""Tables of the domain, derived from the given ones by projection, and readers and writers of its file formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.session import table

#: Oversampling and support of the convolution table.
OVER, SIZE = 8, 8
VIS = "u double, v double, w double, re double, im double"


def visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vis(vis_id, bl, t, u, v, w, re, im): dyadic coordinates and integer amplitudes, so that sums are exact in any order."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber as vis_id",
        "cast(l_suppkey % 16 as int) as bl",
        "cast(l_orderkey % 200 as int) as t",
        "cast((l_partkey * 37 + l_orderkey * 11 + l_linenumber * 101) % 4096 - 2048 as double) / 16.0D as u",
        "cast((l_partkey * 53 + l_orderkey * 29 + l_linenumber * 211) % 4096 - 2048 as double) / 16.0D as v",
        "cast((l_orderkey * 17 + l_linenumber * 5) % 401 - 200 as double) as w",
        "cast(l_orderkey % 7 - 3 as double) as re",
        "cast(l_partkey % 5 - 2 as double) as im",
    )


def convolution_table(spark: SparkSession, over: int = OVER, size: int = SIZE) -> DataFrame:
    """gcf(ou, ov, su, sv, gr, gi): over**2 * size**2 rows of dyadic weights."""
    at = spark.range(over * over * size * size, numPartitions=1).selectExpr(
        f"cast(id div {over * size * size} as int) as ou",
        f"cast(id div {size * size} % {over} as int) as ov",
        f"cast(id div {size} % {size} as int) as su",
        f"cast(id % {size} as int) as sv",
    )
    return at.selectExpr("*", "((su * 3 + sv * 5 + ou + ov) % 8 + 1) / 16.0D as gr", "((su + 2 * sv + ou) % 4 - 1) / 16.0D as gi")


def read_quintuples(spark: SparkSession, path: str) -> DataFrame:
    """Flat little-endian files of five doubles a point (u, v, w, re, im); one task per file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                yield pd.DataFrame(np.frombuffer(data, "<f8").reshape(-1, 5), columns=["u", "v", "w", "re", "im"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, VIS)


def read_vector(spark: SparkSession, path: str, offset: int = 0, n: int | None = None) -> DataFrame:
    """(i, x) of a flat file of doubles, or n of them from an offset."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                x = np.frombuffer(data, "<f8")
                yield pd.DataFrame({"i": np.arange(len(x)), "x": x})

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "i long, x double")
    return vector_slice(out, offset, n)


def vector_slice(vector: DataFrame, offset: int, n: int | None) -> DataFrame:
    """Elements offset to offset + n - 1."""
    return vector.filter(F.col("i") >= offset if n is None else F.col("i").between(offset, offset + n - 1))


def write_by_region(df: DataFrame, path: str, *regions: str) -> None:
    """Dump a grid or image with one folder per region; spark.read.parquet reloads it, a filter on a region reads its folder only."""
    df.write.partitionBy(*regions).parquet(path)


def text_rows(image: DataFrame, most: int = 1000) -> DataFrame:
    """(y, line): an image's rows as text, the first ``most`` rows; the cap is the format's own."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("x", "val"))), lambda c: c["val"].cast("string"))
    return image.filter(F.col("y") < most).groupBy("y").agg(F.array_join(cells, " ").alias("line"))


def select_visibilities(vis: DataFrame, first: int, last: int, baselines: int, points: int) -> DataFrame:
    """Timesteps of a range of points that is aligned to whole baselines; an error otherwise."""
    if first % points or last % points or not 0 <= first < last <= baselines * points:
        raise ValueError(f"range {first}..{last} isn't aligned to baselines of {points} points or is out of range")
    return vis.filter(F.col("bl").between(first // points, last // points - 1))


#: Metres a second.
LIGHT = 299792458.0


def in_wavelengths(vis: DataFrame, hertz: float) -> DataFrame:
    """Coordinates in metres as wavelengths at a frequency."""
    return vis.withColumns({c: F.col(c) * (hertz / LIGHT) for c in "uvw"})


def conjugated(gcf: DataFrame, low: float, high: float) -> DataFrame:
    """A table for the w-range [low, high): conjugated where the range lies further on the negative side."""
    return gcf.withColumn("gi", -F.col("gi")) if low < -high else gcf


def write_ordered(vis: DataFrame, path: str) -> None:
    """Store visibilities dealt by baseline and ordered by (bl, t) within each file, the order gridders read in."""
    vis.repartition("bl").sortWithinPartitions("bl", "t").write.parquet(path)


def constant(vis: DataFrame, re: float, im: float) -> DataFrame:
    """All visibilities at one value; (1, 0) gives the point spread function."""
    return vis.withColumns({"re": F.lit(re), "im": F.lit(im)})


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, block, line, value) of text files: lines with the file they are in, the byte at which their split of it begins, and a number that
    grows within the split, so (block, line) is their order in the file however it was cut. A scan without a sort or a shuffle."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
