"""Temporal URL lists: dated entries become validity intervals; an as-of join judges captures by what was active at fetch time.

A list is a log of dated entries (key, listed_at, action): from its date an entry decides about its key until the key's
next entry; ``remove`` ends it. A key is a domain (``d:example.org``, also for its subdomains) or a host with a path
prefix of whole segments (``p:example.org/a/b``). A capture is judged by its most specific active key: a longer path
before a shorter one, any path before a domain, a longer domain before a shorter one; ``block`` blocks it, ``allow`` and
no entry at all do not.

Intervals and captures are joined on (key, period of PERIOD seconds): an interval is dealt to the periods it spans, so one
host's captures spread over the periods, both sides shuffle by key, and no pair of a capture and an inactive entry leaves
the join. An entry goes only to periods that some capture has, so a capture with a wild time costs nothing. Captures are numbered
and written first; numbers, times and keys are dealt by key, and a row with its content meets its verdict by number, once. A
capture asks for path prefixes as deep as the list's deepest.

Defined results: a null or unparsable url or a null time matches nothing and is not blocked; entries with a null key or
date are ignored; of entries for one key at one second the greatest action in the order allow, block, remove holds;
repeated captures keep a row each; an empty list blocks nothing; extra columns pass through in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import cut

#: Seconds of a period: 30 days.
PERIOD = 30 * 86400
#: Different periods of captures that entries are dealt to one by one; with more of them, entries go to all periods of their span.
PERIODS = 4096


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) from (key, listed_at, action); valid_to is null for what is still valid.

    The next entry of a key is looked up within a period and, for a period's last one, in the first of the key's next
    period, so that a key with very many entries isn't sorted in one task.
    """
    dated = entries.filter("key is not null and listed_at is not null").groupBy("key", "listed_at").agg(F.max("action").alias("action"))
    dated = dated.withColumn("period", F.floor(F.col("listed_at") / PERIOD))
    firsts = dated.groupBy("key", "period").agg(F.min("listed_at").alias("first"))
    later = firsts.select("key", "period", F.lead("first").over(Window.partitionBy("key").orderBy("period")).alias("later"))
    own = Window.partitionBy("key", "period").orderBy("listed_at")
    closed = dated.withColumn("next", F.lead("listed_at").over(own)).join(later, ["key", "period"])
    return closed.select("key", "action", F.col("listed_at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to")).filter("action <> 'remove'")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def depth_of(entries: DataFrame) -> int:
    """Segments of the deepest path prefix listed."""
    most = entries.filter(F.col("key").startswith("p:")).agg(F.max(F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit(""))))).first()[0]
    return most or 0


def candidate_keys(url: Column, depth: int) -> Column:
    """Array of (specificity, key) that may be listed for a url: its domains of two labels or more, its path prefixes of up to
    ``depth`` segments."""
    host, path = host_of(url), path_of(url)
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(labels)
    domains = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (n - i >= 1) | (n == 1)),
        lambda i: F.struct((n - i + 1).alias("rank"), F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")).alias("key")),
    )
    prefixes = F.transform(
        F.slice(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(depth))), 2, depth + 1),
        lambda i: F.struct((i + 1000).alias("rank"), F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key")),
    )
    return F.when(F.length(host) > 0, F.concat(domains, prefixes)).otherwise(F.array().cast("array<struct<rank:int,key:string>>"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", keep: list[str] | None = None) -> DataFrame:
    """One row per capture: row (the columns in keep, all by default), url, fetched_at, matched_key, action, valid_from, blocked."""
    keep = captures.columns if keep is None else keep
    entries = cut(entries.select("key", "listed_at", "action"), "entries")
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    seen = captures.select(F.monotonically_increasing_id().alias("uid"), row.alias("row"), F.col(url_col).alias("url"), F.col(time_col).cast("long").alias("fetched_at"))
    seen = cut(seen, "captures")
    period = F.floor(F.col("fetched_at") / PERIOD)
    asked = seen.select("uid", "fetched_at", period.alias("period"), F.explode(candidate_keys(F.col("url"), depth_of(entries))).alias("c")).select("uid", "fetched_at", "period", "c.*")
    span = seen.agg(F.max("fetched_at").alias("z")).first()["z"]
    valid = intervals(entries).filter(F.col("valid_from") <= F.lit(span if span is not None else -1))
    last = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(span)), F.lit(span))
    first, last = F.floor(F.col("valid_from") / PERIOD), F.floor(last / PERIOD)
    known = sorted(r["p"] for r in seen.filter("fetched_at is not null").select(period.alias("p")).distinct().limit(PERIODS + 1).collect())
    # an open entry is in force for ever, but is only asked for in periods that some capture has
    held = F.sequence(first, last) if len(known) > PERIODS else F.filter(F.array(*map(F.lit, known)).cast("array<bigint>"), lambda p: p.between(first, last))
    dealt = valid.filter("valid_to is null or valid_to > valid_from").select(F.col("key").alias("k"), "action", "valid_from", "valid_to", F.explode(held).alias("p"))
    active = (F.col("key") == F.col("k")) & (F.col("period") == F.col("p")) & (F.col("fetched_at") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))
    )
    hits = asked.join(dealt, active).groupBy("uid").agg(F.max(F.struct("rank", F.col("k").alias("key"), "action", "valid_from")).alias("hit"))
    best = seen.join(hits, "uid", "left")
    return best.select(
        "row",
        "url",
        "fetched_at",
        F.col("hit.key").alias("matched_key"),
        F.col("hit.action").alias("action"),
        F.col("hit.valid_from").alias("valid_from"),
        F.coalesce(F.col("hit.action") == "block", F.lit(False)).alias("blocked"),
    )
