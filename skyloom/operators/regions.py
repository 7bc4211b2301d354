"""Regions and shares: interval merges, keyed unions, recovery of missing parts, work shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.scans import Running, bounds, scan


def prefer(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Union by key; where both have a key, the left one's rows."""
    return left.unionByName(right.join(left.select(*keys).distinct(), list(keys), "left_anti"))


def recover(expected: DataFrame, found: DataFrame, default: dict[str, Column], *keys: str) -> DataFrame:
    """found, with default rows for expected keys that are missing."""
    missing = expected.select(*keys).distinct().join(found, list(keys), "left_anti").withColumns(default)
    return found.unionByName(missing)


def merge_ranges(ranges: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo, hi, n): half-open ranges that touch or overlap become one, per key."""
    inner = bounds(ranges, "lo")
    reached = scan(ranges, list(keys), ["lo", "hi"], inner, reach=Running("max", F.col("hi"), own=False))
    started = reached.withColumn("new", F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1))
    islands = scan(started, list(keys), ["lo", "hi"], inner, island=Running("sum", F.col("new")))
    return islands.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("island")


def range_split(low: int, high: int, parts: int, i: Column) -> tuple[Column, Column]:
    """Ends of part i of [low, high)."""
    edge = lambda k: F.lit(low) + F.floor(F.lit(high - low) * k / parts).cast("long")
    return edge(i), edge(i + 1)


#: Steps up to which they become an array literal.
LITERAL = 1000


def as_of(points: DataFrame, steps: DataFrame, at: str, key: str, literal: int = LITERAL) -> DataFrame:
    """Each point with the step whose key is the greatest not above it, null if none is or the point has no place. Keys of steps differ. Up to
    ``literal`` steps are an array literal and need no join; more are put among the points in order, and the last step is carried on
    from bucket to bucket of the range (``scans``), so neither steps nor points meet in one task."""
    if steps.limit(literal + 1).count() <= literal:
        rows = [tuple(r) for r in steps.orderBy(key).collect()]
        each = [F.struct(*[F.lit(v).cast(steps.schema[n].dataType).alias(n) for n, v in zip(steps.columns, r)]) for r in rows]
        kind = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in steps.schema])
        found = F.try_element_at(F.filter(F.array(*each), lambda s: s[key] <= F.col(at)), F.lit(-1)) if each else F.when(F.lit(False), kind)
        return points.withColumn("_step", found).select("*", "_step.*").drop("_step")
    place = points.schema[at].dataType
    step = steps.filter(F.col(key).isNotNull()).select(F.col(key).cast(place).alias("_at"), F.lit(0).alias("_kind"), F.struct("*").alias("_step"))
    both = points.select(F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct("*").alias("_point")).unionByName(step, allowMissingColumns=True)
    held = scan(both, [], ["_at", "_kind"], last=Running("last", F.col("_step"))).filter("_kind = 1")
    return held.select("_point.*", F.when(F.col("_at").isNotNull(), F.col("last")).alias("_step")).select("*", "_step.*").drop("_step")


def least_span(work: DataFrame, size: str, parts: int) -> DataFrame:
    """Adds nodes and span: the least span such that items of ``size``, each cut into ceil(size / span) nodes, take at most
    ``parts`` nodes in all. Candidates are size / k, parts of them an item, so items are few by contract; null where no span does."""
    each = work.select(F.col(size).cast("double").alias("size"))
    spans = each.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda k: F.col("size") / k)).alias("span")).distinct()
    needs = F.ceil(F.col("size") / F.col("span"))
    best = each.join(F.broadcast(spans)).groupBy("span").agg(F.sum(needs).alias("n")).filter(F.col("n") <= parts).agg(F.min("span").alias("least"))
    return work.join(F.broadcast(best)).withColumns({"nodes": F.ceil(F.col(size) / F.col("least")).cast("int"), "span": F.col("least")}).drop("least")


def shares(items: DataFrame, order: str, weight: str, total: int) -> DataFrame:
    """Adds n, how many of total units each item gets when the unit line is cut at its cumulative share of the weight."""
    run = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum(weight).over(run) / F.sum(weight).over(Window.partitionBy())
    low = (F.sum(weight).over(run) - F.col(weight)) / F.sum(weight).over(Window.partitionBy())
    return items.withColumn("n", (F.floor(high * total) - F.floor(low * total)).cast("long"))


def in_range(points: DataFrame, ranges: DataFrame, at: str, literal: int = LITERAL) -> DataFrame:
    """Each point with the half-open range [lo, hi) that holds it, null if none does. Ranges don't overlap; any number of them, as in as_of()."""
    held = as_of(points, ranges, at, "lo", literal)
    return held.withColumns({c: F.when(F.col(at) < F.col("hi"), F.col(c)) for c in ranges.columns if c != "hi"}).withColumn("hi", F.when(F.col("lo").isNotNull(), F.col("hi")))


def subset(lo: Column, hi: Column, of_lo: Column, of_hi: Column) -> Column:
    """Whether [lo, hi) lies in [of_lo, of_hi)."""
    return (lo >= of_lo) & (hi <= of_hi)
