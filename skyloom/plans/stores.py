"""Registered queries on flat files, ordered joins and scans, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import regions as R
from skyloom.plans.derived import VIS
from skyloom.session import new_path, table
from skyloom.sources import records
from skyloom.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


FIELDS = ["n", "qty", "low", "high", "lines"]


def part_records(spark, sf_dir):
    """Five numbers a part, by a dense index."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").cast("double").alias("n"), F.sum("l_linenumber").cast("double").alias("lines"), F.min("l_orderkey").cast("double").alias("low"),
        F.max("l_orderkey").cast("double").alias("high"), F.sum(F.floor("l_quantity")).cast("double").alias("qty"))
    every = table(spark, sf_dir, "part").select("p_partkey").join(sums, "p_partkey", "left")
    return every.select(F.col("p_partkey").alias("i"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FIELDS])


_PARTS = """p as (select p_partkey as i, cast(count(l_orderkey) as double) as n, coalesce(cast(sum(floor(l_quantity)) as double), 0) as qty, coalesce(cast(min(l_orderkey) as double), 0) as low,
    coalesce(cast(max(l_orderkey) as double), 0) as high, coalesce(cast(sum(l_linenumber) as double), 0) as lines from part left join lineitem on l_partkey = p_partkey group by p_partkey)"""


@query(f"with {_PARTS} select i, n, qty, low, high, lines from p")
def s7_records(spark, sf_dir):
    """Records of five doubles written to flat files of 4096 and read again, each file by byte ranges of 64 KiB."""
    path = new_path(spark, "records")
    records.write_records(part_records(spark, sf_dir), path, FIELDS, "i", 4096)
    back = records.read_records(spark, path, FIELDS, span=1 << 16)
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    return back.select((number * 4096 + F.col("row")).alias("i"), *FIELDS)


@query(f"with {_PARTS} select i, qty as x from p where i between 100 and 1299")
def s14_vector(spark, sf_dir):
    """A vector written as one flat file, and 1200 of its elements from an offset read back."""
    path = new_path(spark, "vector")
    records.write_records(part_records(spark, sf_dir), path, ["qty"], "i", 1 << 30)
    whole = records.read_records(spark, path, ["qty"], span=1 << 14).select(F.col("row").alias("i"), F.col("qty").alias("x"))
    return T.vector_slice(whole, 100, 1200)


#: Timesteps, channels, baselines and complex parts.
SHAPE = [200, 4, 16, 2]


@query(
    f"""with {VIS}, a as (select t, vis_id % 8 % 4 as ch, bl, sum(re) as re, sum(im) as im from vis group by all),
    c as (select t, ch, bl, 0 as part, re as val from a union all select t, ch, bl, 1, im from a),
    o as (select i // 1600 as bl, i // 8 % 200 as t, i // 2 % 4 as ch, i % 2 as part, i from range(25600) r(i))
    select o.i, coalesce(val, 0) as val from o left join c on c.bl = o.bl and c.t = o.t and c.ch = o.ch and c.part = o.part"""
)
def s6_axis_order(spark, sf_dir):
    """Amplitudes (time, channel, baseline, part) written with the baseline's axis first, and read back in the order of the file."""
    ch = (F.col("vis_id") % 8) % 4
    sums = T.visibilities(spark, sf_dir).groupBy("t", ch.alias("ch"), "bl").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    at = ((F.col("t") * 4 + F.col("ch")) * 16 + F.col("bl")) * 2
    cells = sums.select(F.inline(F.array(F.struct(at.cast("long").alias("i"), F.col("re").alias("val")), F.struct((at + 1).cast("long").alias("i"), F.col("im").alias("val")))))
    whole = spark.range(25600).withColumnRenamed("id", "i").join(cells, "i", "left").select(records.permuted(F.col("i"), SHAPE, [2, 0, 1, 3]).alias("i"), F.coalesce("val", F.lit(0.0)).alias("val"))
    path = new_path(spark, "axes")
    records.write_records(whole, path, ["val"], "i", 1 << 30)
    return records.read_records(spark, path, ["val"], span=1 << 15).select(F.col("row").alias("i"), "val")


@query("select l_orderkey, l_linenumber, step, o_custkey from lineitem asof left join (select o_orderkey * 2 as step, o_custkey from orders where o_orderkey % 5 = 0) o on l_orderkey >= o.step")
def j5_as_of(spark, sf_dir):
    """Lines with the last of a table of steps, as many as a fifth of all orders, that isn't past them."""
    steps = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select((F.col("o_orderkey") * 2).alias("step"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return R.as_of(lines, steps, "l_orderkey", "step")


@query("select l_orderkey, l_linenumber, lo, hi, o_custkey from lineitem left join (select o_orderkey as lo, o_orderkey + o_custkey % 3 as hi, o_custkey from orders where o_orderkey % 5 = 0) o on l_orderkey >= lo and l_orderkey < hi")
def j6_in_range(spark, sf_dir):
    """Lines with the range of order keys that holds them, if any; a fifth of all orders begin one."""
    ranges = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.col("o_custkey") % 3).alias("hi"), "o_custkey")
    return R.in_range(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ranges, "l_orderkey")
