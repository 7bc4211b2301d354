"""Registered queries over vectors, words, keyed unions and shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import binning as B
from skyloom.operators import regions as R
from skyloom.operators import vectors as V
from skyloom.operators import words as W
from skyloom.session import cut, table
from skyloom.sources.tables import vector_slice

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_I = "l_orderkey * 64 + l_linenumber * 8 + l_partkey % 8"


def vector(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """A column of lineitem summed by a computed index, so that each index occurs once."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 64 + F.col("l_linenumber") * 8 + F.col("l_partkey") % 8).alias("i"), F.col(column).alias("x"))
    return rows.groupBy("i").agg(F.sum("x").alias("x"))


_VECTORS = f"a as (select {_I} as i, sum(l_quantity) as x from lineitem group by all), b as (select {_I} as i, sum(l_linenumber) as x from lineitem group by all)"


@query(f"with {_VECTORS} select sum(a.x * b.x) as dot from a join b on a.i = b.i")
def a3_dot(spark, sf_dir):
    return V.dot(vector(spark, sf_dir, "l_quantity"), vector(spark, sf_dir, "l_linenumber"))


@query("select sum(l_quantity) as total, count(*) as n, sum(l_quantity * l_linenumber) as weighted from lineitem")
def a1_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity").alias("total"), F.count("*").alias("n"), F.sum(F.col("l_quantity") * F.col("l_linenumber")).alias("weighted"))


@query(f"with {_VECTORS} select a.i, a.x * b.x as x from a join b on a.i = b.i")
def j1_zip(spark, sf_dir):
    """Element-wise product of two vectors."""
    return V.zip_with(vector(spark, sf_dir, "l_quantity"), vector(spark, sf_dir, "l_linenumber"), lambda x, y: x * y)


@query(f"with {_VECTORS} select a.i, a.x * 3 + b.x as x from a join b on a.i = b.i")
def p16_daxpy(spark, sf_dir):
    return V.zip_with(vector(spark, sf_dir, "l_quantity"), vector(spark, sf_dir, "l_linenumber"), lambda x, y: x * 3 + y)


@query(f"with {_VECTORS} select a.i, a.x - b.x as x from a join b on a.i = b.i")
def p17_subtract(spark, sf_dir):
    return V.zip_with(vector(spark, sf_dir, "l_quantity"), vector(spark, sf_dir, "l_linenumber"), lambda x, y: x - y)


@query("select l_orderkey, l_linenumber, l_quantity * 0.5 + 10 as affine, case when l_quantity % 2 > 0 then l_quantity + 10 else l_quantity end as choice from lineitem")
def p13_affine_choice(spark, sf_dir):
    """Affine transform, and the data-dependent choice that adds ten to odd values."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q * 0.5 + 10).alias("affine"), F.when(q % 2 > 0, q + 10).otherwise(q).alias("choice"))


@query("select p_partkey, round(sqrt(p_retailprice), 3) as root from part")
def p14_newton_sqrt(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(V.newton_sqrt(F.col("p_retailprice")), 3).alias("root"))


@query("select cast(i as bigint) as i, x, cast(sum(x) over (order by i) as bigint) as total from (select l_orderkey as i, sum(l_linenumber) as x from lineitem group by all)")
def w1_prefix_sum(spark, sf_dir):
    """Prefix sums over all orders, in two levels instead of one sorted task."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("i")).agg(F.sum("l_linenumber").alias("x"))
    return V.running_total(x, "i", "x", 4096).select("i", "x", "total")


@query(f"with {_VECTORS} select i, x from a where i between 5000 and 94999")
def s9_slice(spark, sf_dir):
    """Elements of a vector from an offset."""
    return vector_slice(vector(spark, sf_dir, "l_quantity"), 5000, 90000)


@query(
    """with s as (select l_partkey * 10 as x, sum(l_linenumber) as v from lineitem group by all), n as (select max(x) + 1 as n from s),
    d as (select unnest(range(n)) as x from n) select cast(d.x // 500 as integer) as tile, d.x, coalesce(v, 0) as v from d left join s on s.x = d.x"""
)
def m23_dense_tiles(spark, sf_dir):
    """A sparse array (every tenth cell) as a dense one in tiles of 500."""
    s = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 10).alias("x"), F.col("l_linenumber").alias("v"))
    n = s.agg(F.max("x")).first()[0] + 1
    return B.densify(s, n, 500)


def _partition_sql(parts: int) -> str:
    """The dynamic programme over prefix sums, a table per part; then the cuts from the last part to the first."""
    months = "m as (select year(o_orderdate) * 12 + month(o_orderdate) - 1 as m, sum(o_totalprice) as s from orders group by all)"
    sums = "p as (select 0 as i, cast(0 as double) as p union all select row_number() over (order by m) as i, sum(s) over (order by m) as p from m)"
    out = [months, "n as (select *, row_number() over (order by m) as i from m)", sums, "c1 as materialized (select i, p as cost, cast(0 as bigint) as back from p)"]
    for k in range(2, parts + 1):
        out.append(
            f"c{k} as materialized (select j.i, min(greatest(c.cost, j.p - a.p)) as cost, arg_min(a.i, (greatest(c.cost, j.p - a.p), a.i)) as back from p j join p a on a.i < j.i join c{k - 1} c on c.i = a.i group by j.i union all select 0, 0, 0)"
        )
    out.append(f"z{parts} as (select max(i) as z from p)")
    for k in range(parts, 1, -1):
        out.append(f"z{k - 1} as (select back as z from c{k}, z{k} where i = z)")
    first = " + ".join(f"cast(i > (select z from z{k}) as integer)" for k in range(1, parts))
    return f"with {', '.join(out)} select cast(m as integer) as m, {first} as part, round(s, 2) as s from n"


@query(_partition_sql(12))
def m22_linear_partition(spark, sf_dir):
    """Months of orders in twelve contiguous parts with the least greatest revenue; the programme sees one sum a month."""
    months = table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("m")).agg(F.sum("o_totalprice").alias("s"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        part = np.array(V.linear_partition(list(zip(pdf["m"], pdf["s"])), 12), np.int32)
        return pd.DataFrame({"m": pdf["m"].astype(np.int32), "part": part, "s": pdf["s"].round(2)})

    return months.groupBy().applyInPandas(solve, "m int, part int, s double")


@query("select w as word, count(*) as n from (select unnest(string_split_regex(lower(text), '\\P{L}+')) as w from documents) where w <> '' group by all")
def a7_word_count(spark, sf_dir):
    return W.word_counts(table(spark, sf_dir, "documents"))


@query("select w as word, count(*) as n from (select unnest(string_split_regex(lower(text), '\\P{L}+')) as w from documents) where w <> '' group by all order by n desc, word desc limit 1000")
def o10_top_words(spark, sf_dir):
    """The thousand most frequent words; equal counts in reverse order of word."""
    return W.top_words(W.word_counts(table(spark, sf_dir, "documents")))


@query("select substr(w, 1, 1) as initial, count(*) as words, count(distinct w) as keys from (select unnest(string_split_regex(lower(text), '\\P{L}+')) as w from documents) where w <> '' group by all")
def d15_word_routing(spark, sf_dir):
    """Words by their initial letter, by which a map-reduce over words would deal them."""
    return W.by_initial(W.word_counts(table(spark, sf_dir, "documents")))


_SIDES = "a as (select o_custkey as k, count(*) as n, 'orders' as side from orders where o_orderpriority = '1-URGENT' and o_custkey % 3 > 0 group by o_custkey), b as (select c_custkey as k, cast(0 as bigint) as n, 'customer' as side from customer where c_custkey % 4 > 0)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers with urgent orders, but for every third, and customers, but for every fourth: each side has keys of its own."""
    a = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_custkey % 3 > 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("side", F.lit("orders"))
    b = table(spark, sf_dir, "customer").filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("n"), F.lit("customer").alias("side"))
    return a, b


@query(f"with {_SIDES} select * from a union all select * from b where k not in (select k from a)")
def u1_left_biased_union(spark, sf_dir):
    return R.prefer(*_sides(spark, sf_dir), "k")


@query(f"with {_SIDES} select b.* from b where k not in (select k from a)")
def u2_difference(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return b.join(a, "k", "left_anti")


@query(f"with {_SIDES} select k, n, side from a union all select k, 0, 'recovered' from b where k not in (select k from a)")
def j11_recover(spark, sf_dir):
    """Customers without such orders get a default row."""
    a, b = _sides(spark, sf_dir)
    return R.recover(b, a, {"n": F.lit(0).cast("long"), "side": F.lit("recovered")}, "k")


@query("select * from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def j9_region_select(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi")


@query(
    """with r as (select n_nationkey, r_regionkey from nation, region), c as (select c_nationkey, count(*) as n from customer group by all)
    select n_nationkey, r_regionkey, n from r join c on c_nationkey = n_nationkey"""
)
def j10_region_product(spark, sf_dir):
    """Boxes of two domains, nation by region, less those that nothing depends on. Both domains are lists of fixed length."""
    boxes = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_regionkey")))
    held = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return boxes.join(held, "n_nationkey")


@query(
    """with r as (select l_suppkey as k, l_orderkey * 10 as lo, l_orderkey * 10 + l_linenumber * 40 as hi from lineitem),
    s as (select *, case when lo <= max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from r),
    i as (select *, sum(new) over (partition by k order by lo, hi) as island from s) select k, min(lo) as lo, max(hi) as hi, count(*) as n from i group by k, island"""
)
def u3_merge_ranges(spark, sf_dir):
    ranges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10).alias("lo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") * 40).alias("hi"))
    return R.merge_ranges(ranges, "k")


@query("select least(6, l_partkey * 7 // (1 + (select max(l_partkey) from lineitem))) as part, count(*) as n from lineitem group by all")
def f6_range_split(spark, sf_dir):
    """Rows per part of the range of part keys split in seven, each part's ends computed and joined as an interval by arithmetic."""
    rows = table(spark, sf_dir, "lineitem")
    high = rows.agg(F.max("l_partkey")).first()[0] + 1
    guess = F.least(F.lit(6), F.floor(F.col("l_partkey") * 7 / high))
    lo, _ = R.range_split(0, high, 7, guess)
    return rows.groupBy(F.when(F.col("l_partkey") < lo, guess - 1).otherwise(guess).cast("long").alias("part")).agg(F.count("*").alias("n"))


@query(
    """with w as (select c_nationkey as item, count(*) as weight from customer group by all),
    s as (select item, weight, sum(weight) over (order by item) as hi, sum(weight) over () as total from w)
    select item, weight, cast(floor(cast(hi as double) / cast(total as double) * 1000) - floor(cast(hi - weight as double) / cast(total as double) * 1000) as bigint) as n from s"""
)
def x6_shares(spark, sf_dir):
    """A thousand units of work dealt to nations by their cumulative share of customers."""
    weights = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("item")).agg(F.count("*").alias("weight"))
    return R.shares(weights, "item", "weight", 1000)


@query(
    """with w as (select n_regionkey as region, count(*) as n from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by all),
    s as (select distinct n / k as span from w, range(1, 17) r(k)), f as (select span from s, w group by span having sum(ceil(n / span)) <= 16)
    select region, n, cast(ceil(n / span) as integer) as nodes, span from w, (select min(span) as span from f)"""
)
def x5_balance(spark, sf_dir):
    """The least number of orders a share at which the five regions' orders make at most sixteen shares."""
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("region")), "o_custkey")
    return R.least_span(cut(orders.groupBy("region").agg(F.count("*").alias("n")), "work"), "n", 16)


@query("select l_suppkey % 50 as rank, sum(l_quantity) filter (where l_discount < 0.1) as s, count(*) filter (where l_discount >= 0.1) as failed from lineitem group by all")
def d10_failout(spark, sf_dir):
    """Sums by region that go on without rows that fail a check, and how many those are."""
    valid = F.col("l_discount") < 0.1
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("rank")).agg(F.sum(F.when(valid, F.col("l_quantity"))).alias("s"), F.count_if(~valid).alias("failed"))


@query("select l_suppkey as k, count(*) as n, count(*) filter (where l_orderkey * 10 >= 20000 and l_orderkey * 10 + l_linenumber * 40 <= 90000) as inside from lineitem group by all")
def u4_subset(spark, sf_dir):
    """By supplier: ranges, and those that lie within another range."""
    lo, hi = F.col("l_orderkey") * 10, F.col("l_orderkey") * 10 + F.col("l_linenumber") * 40
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(R.subset(lo, hi, F.lit(20000), F.lit(90000))).alias("inside"))


@query("select l_orderkey // 1000 as chunk, count(*) as n, sum(l_quantity) as s from lineitem group by all")
def o7_chunks(spark, sf_dir):
    """Sums of consecutive chunks of a thousand order keys."""
    return V.chunks(table(spark, sf_dir, "lineitem"), "l_orderkey", 1000).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"))


@query("select vec_id, list_sum(list_transform(embedding, lambda x: cast(floor(x * 1000) as bigint))) as folded from embeddings")
def a2_fold(spark, sf_dir):
    """Left fold over each embedding, multiplied in its elements' own precision. Null elements are passed over, an embedding without others
    gives null. An element that has no 64-bit whole number fails the query, as it does in SQL; so does a sum that has none (SQL's has 128 bits)."""

    def whole(x):
        scaled = (x * F.lit(1000).cast("float")).cast("double")  # a product of doubles may fall on the other side of a whole number
        return F.when((scaled < -(2.0**63)) | (scaled >= 2.0**63), F.raise_error("no 64-bit whole number").cast("long")).otherwise(F.floor(scaled)).cast("decimal(38,0)")

    folded = V.fold(F.transform("embedding", whole), F.lit(None).cast("decimal(38,0)"), lambda s, x: F.coalesce(s + x, s, x), lambda s: s.cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", folded.alias("folded"))
