"""Analytics over kernel logs: text lines to paired invocations to metrics, as relational queries.

A line is ``time: cap N: TAG [attr]* message``; START and END lines of a message on one processor pair up in order.
Numbers of lines, running times and split messages are scans in two levels (``scans``), so no processor's or kernel's lines meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.scans import Running, scan

LINE = r"^(\d+): cap (\d+): (\w+) ((?:\[[^\]]*\] ?)*)(.*)$"
#: Weights of scalar, 128-bit and 256-bit operations, and the device rate that efficiency is measured against.
FLOP_WEIGHTS, DEVICE_RATE = (1, 2, 4), 100e9


def parse_lines(lines: DataFrame) -> DataFrame:
    """(ts, pid, tag, attrs, msg) of text lines in ``value``; a line that doesn't parse has tag RAW."""
    part = lambda i: F.regexp_extract("value", LINE, i)
    ok = F.col("value").rlike(LINE)
    pairs = F.regexp_extract_all(part(4), F.lit(r"\[([^=\]]+)=([^\]]*)\]"), 0)
    attrs = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"\[([^=\]]+)=", 1), F.regexp_extract(p, r"=([^\]]*)\]", 1).cast("double")))))
    return lines.select(
        F.when(ok, part(1)).cast("long").alias("ts"),
        F.when(ok, part(2)).cast("long").alias("pid"),
        F.when(ok, part(3)).otherwise("RAW").alias("tag"),
        F.when(ok, attrs).alias("attrs"),
        F.when(ok, part(5)).otherwise(F.col("value")).alias("msg"),
    )


def glue(lines: DataFrame, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """Lines (log, value and what orders them, ``at`` if not told) whose message was split: ``...[[n]]`` goes on in the next line of the log that
    starts with ``[[n]]``; a message is known by the place of its first line. Lines without a mark pass straight through."""
    number = F.coalesce(F.nullif(F.regexp_extract("value", r"^\[\[(\d+)\]\]", 1), F.lit("")), F.nullif(F.regexp_extract("value", r"\[\[(\d+)\]\]$", 1), F.lit("")))
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    marked = lines.withColumns({"number": number, "place": at})
    split = marked.filter("number is not null")
    first = ~F.col("value").rlike(r"^\[\[\d+\]\]")
    started = scan(split, ["log", "number"], list(order), start=Running("last", F.when(first, F.col("place"))))
    text = F.regexp_replace("value", r"^\[\[\d+\]\]|\[\[\d+\]\]$", "")
    held = started.select("log", "number", "start", "place", text.alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    glued = held.groupBy("log", "number", "start").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("value"))
    return marked.filter("number is null").select("log", F.col("place").alias("at"), "value").unionByName(glued.select("log", F.col("start").alias("at"), "value"))


def pair(entries: DataFrame) -> DataFrame:
    """(pid, msg, occurrence, start, stop, start_attrs, end_attrs) of the START and END lines that pair, ties of time in the order of
    their attributes; the rest have a null side."""
    ends = entries.filter(F.col("tag").isin("START", "END")).withColumn("tie", F.to_json("attrs"))
    numbered = scan(ends, ["pid", "msg", "tag"], ["ts", "tie"], occurrence=Running("count")).drop("tie")
    side = lambda tag, ts, attrs: numbered.filter(F.col("tag") == tag).select("pid", "msg", "occurrence", F.col("ts").alias(ts), F.col("attrs").alias(attrs))
    return side("START", "start", "start_attrs").join(side("END", "stop", "end_attrs"), ["pid", "msg", "occurrence"], "full")


def differences(paired: DataFrame, *counters: str) -> DataFrame:
    """Adds each counter's value at the end less that at the start, missing ones as zero."""
    at = lambda side, c: F.coalesce(F.col(side)[c], F.lit(0.0))
    return paired.withColumns({c: at("end_attrs", c) - at("start_attrs", c) for c in counters})


def kernel_totals(calls: DataFrame, *sums: str) -> DataFrame:
    """(msg, n, t, sums): invocations, total time and sums of columns per kernel."""
    return calls.groupBy("msg").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("t"), *[F.sum(c).alias(c) for c in sums])


def flop_rate(totals: DataFrame) -> DataFrame:
    """Adds rate: weighted operations per second of scalar, sse and avx counters over t milliseconds."""
    work = sum(F.col(c) * w for c, w in zip(("scalar", "sse", "avx"), FLOP_WEIGHTS))
    return totals.withColumn("rate", F.when(F.col("t") > 0, work / F.col("t") * 1000.0))


def error_class(value: str, hint: str):
    """How far a measured value is from its hint: error from a ratio of 1.5, warning from 1.1, else ok; hint if nothing was measured."""
    v, h = F.col(value), F.col(hint)
    ratio = F.greatest(v / h, h / v)
    return F.when(v.isNull() | (v == 0), "hint").when(h.isNull() | (h == 0), "none").when(ratio >= 1.5, "error").when(ratio >= 1.1, "warning").otherwise("ok")


def efficiency(value: str, hint: str, seconds: str):
    v = F.when(F.col(value) > 0, F.col(value)).otherwise(F.col(hint))
    return F.when(F.col(seconds) > 0, v / F.lit(DEVICE_RATE) / F.col(seconds))


def time_shares(totals: DataFrame) -> DataFrame:
    """Adds share, each kernel's part of all time. One row a kernel."""
    return totals.withColumn("share", F.col("t") / F.sum("t").over(Window.partitionBy()))


def align_clocks(entries: DataFrame) -> DataFrame:
    """Times relative to the first of all logs, so that offsets between logs stay; the minimum is one number."""
    first = entries.agg(F.min("ts")).first()[0]
    return entries.withColumn("ts", F.col("ts") - F.lit(first))


def iterations(entries: DataFrame, log: str, init: str, step: str) -> DataFrame:
    """(log, ts, since): time from the first ``init`` to each ``step`` of a log."""
    start = entries.filter(F.col("msg") == init).groupBy(log).agg(F.min("ts").alias("t0"))
    return entries.filter(F.col("msg") == step).join(start, log).select(log, "ts", (F.col("ts") - F.col("t0")).alias("since"))


def busy_timeline(calls: DataFrame, row: str) -> DataFrame:
    """Adds busy, the running duration of a row's calls before each: the timeline with idle time taken out."""
    took = Running("sum", F.col("stop") - F.col("start"), own=False)
    return scan(calls, [row], ["start", "stop"], busy=took)


def named_past_first(entries: DataFrame, *names: str) -> DataFrame:
    """Entries whose message, less its first letter, is one of the names: so a kernel is found under either case of that letter,
    and ``DegridX`` isn't taken for a ``GridX``."""
    return entries.filter(F.substring("msg", 2, 1 << 30).isin(*names))


def launch_lists(lines: DataFrame, what: str, order: str = "at") -> DataFrame:
    """(log, values): the quoted list of each log's first line ``capset n: <what>: ["...","..."]``, cut at ``","``."""
    pattern = rf'^capset [0-9]+: {what}: \["(.*)"\]'
    first = lines.filter(F.col("value").rlike(pattern)).groupBy("log").agg(F.min_by("value", order).alias("value"))
    return first.select("log", F.split(F.regexp_extract("value", pattern, 1), '","').alias("values"))


def program_args(lines: DataFrame, order: str = "at") -> DataFrame:
    """(log, values): arguments of the program that wrote a log; a log without them has no row."""
    return launch_lists(lines, "args", order)


def program_env(lines: DataFrame, order: str = "at") -> DataFrame:
    """(log, env): its environment as a map; entries that aren't ``name=value`` are left out, the last of a name holds."""
    held = launch_lists(lines, "env", order).withColumn("p", F.expr("transform(filter(values, v -> v rlike '^(?U)\\\\w+='), v -> struct(substring_index(v, '=', 1) as key, substring(v, instr(v, '=') + 1) as value))"))
    keys = F.array_distinct(F.transform("p", lambda e: e["key"]))
    last = F.expr("transform(k, x -> struct(x as key, element_at(filter(p, e -> e.key = x), -1).value as value))")
    return held.withColumn("k", keys).select("log", F.map_from_entries(last).alias("env"))


def counter_families(attrs: Column) -> Column:
    """Array of (family, name, value, time) of an attribute map with keys such as ``hint:gpu-double-ops`` or ``perf:scalar-double``.
    A value ``v/t`` is a counter with the time it was measured over; a plain one has no time; one that is no number has neither."""
    entry = lambda e: F.struct(
        F.when(e["key"].contains(":"), F.substring_index(e["key"], ":", 1)).alias("family"),
        F.substring_index(e["key"], ":", -1).alias("name"),
        F.substring_index(e["value"], "/", 1).try_cast("double").alias("value"),
        F.when(e["value"].contains("/"), F.substring_index(e["value"], "/", -1).try_cast("double")).alias("time"),
    )
    return F.transform(F.map_entries(attrs), entry)


def text_attributes(attrs: Column) -> Column:
    """Map of the ``[name=value]`` attributes of a line, values as text; the last of a name holds."""
    pairs = F.regexp_extract_all(attrs, F.lit(r"\[([^=\]]+)=([^\]]*)\]"), 0)
    named = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"\[([^=\]]+)=", 1).alias("key"), F.regexp_extract(p, r"=([^\]]*)\]", 1).alias("value")))
    keys = F.array_distinct(F.transform(named, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(named, lambda e: e["key"] == k), -1)["value"])))


def device_metrics(calls: DataFrame) -> DataFrame:
    """(msg, n, kernel_time, transfer_time, transferred, flops, rate): device work per kernel from the ``cuda`` counters of its
    calls (time in ns in kernels, time and bytes of copies, floating point operations), with operations a second of kernel time."""
    c = lambda name: F.coalesce(F.sum(name), F.lit(0.0))
    sums = calls.groupBy("msg").agg(F.count("*").alias("n"), *[c(x).alias(x) for x in ("kernel_time", "transfer_time", "transferred", "flops")])
    return sums.withColumn("rate", F.when(F.col("kernel_time") > 0, F.col("flops") / F.col("kernel_time") * 1e9))
