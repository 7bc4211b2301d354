"""Registered log-analytics queries; the log is made of events, a START and an END line each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import logs as L
from skyloom.plans.derived import LOG
from skyloom.session import new_path, table
from skyloom.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of the log."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("start"), F.floor("value").alias("took")
    )
    text = lambda at, tag, scalar, sse: F.format_string(f"%d: cap %d: {tag} [scalar=%d] [sse=%d] %s", at, F.col("user_id"), scalar, sse, F.col("event_type"))
    scalar, sse = F.col("event_id") % 97, F.col("event_id") % 31
    both = F.array(text(F.col("start"), "START", scalar, sse), text(F.col("start") + 1 + F.col("took"), "END", scalar + F.col("took"), sse + 5))
    return e.select(F.explode(both).alias("value"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_lines(lines(spark, sf_dir))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.differences(L.pair(entries(spark, sf_dir)), "scalar", "sse", "avx")


_PAIRS = f"""{LOG}, s as (select pid, msg, start, scalar0, sse0, row_number() over (partition by pid, msg order by start) as occurrence from log),
    e as (select pid, msg, stop, scalar1, sse1, row_number() over (partition by pid, msg order by stop, scalar1) as occurrence from log),
    calls as (select pid, msg, occurrence, start, stop, cast(scalar1 - scalar0 as double) as scalar, cast(sse1 - sse0 as double) as sse from s join e using (pid, msg, occurrence))"""
_TOTALS = f"{_PAIRS}, totals as (select msg, count(*) as n, cast(sum(stop - start) as bigint) as t, sum(scalar) as scalar, sum(sse) as sse from calls group by msg)"


@query(
    f"""with {LOG} select start as ts, pid, 'START' as tag, cast(scalar0 as double) as scalar, cast(sse0 as double) as sse, msg from log
    union all select stop, pid, 'END', cast(scalar1 as double), cast(sse1 as double), msg from log"""
)
def l1_parse(spark, sf_dir):
    """Text lines to typed entries with their attributes."""
    return entries(spark, sf_dir).select("ts", "pid", "tag", F.col("attrs")["scalar"].alias("scalar"), F.col("attrs")["sse"].alias("sse"), "msg")


@query(f"with {_PAIRS} select pid, msg, occurrence, start, stop from calls")
def l4_pair(spark, sf_dir):
    return L.pair(entries(spark, sf_dir)).select("pid", "msg", F.col("occurrence").cast("long").alias("occurrence"), "start", "stop")


@query(f"with {_TOTALS} select * from totals")
def l6_kernel_totals(spark, sf_dir):
    """Invocations, time and counter differences per kernel."""
    return L.kernel_totals(calls(spark, sf_dir), "scalar", "sse")


@query(f"with {_TOTALS} select msg, round((scalar + 2 * sse) / t * 1000, 6) as rate from totals")
def l9_flop_rate(spark, sf_dir):
    return L.flop_rate(L.kernel_totals(calls(spark, sf_dir), "scalar", "sse", "avx")).select("msg", F.round("rate", 6).alias("rate"))


@query(f"with {_TOTALS} select msg, round(t / sum(t) over (), 9) as share from totals")
def l14_time_shares(spark, sf_dir):
    return L.time_shares(L.kernel_totals(calls(spark, sf_dir))).select("msg", F.round("share", 9).alias("share"))


@query(
    f"""with {_PAIRS}, c as (select pid, sum(scalar) as val, sum(sse) * 6.0 as hint, cast(sum(stop - start) as double) / 1000.0 as seconds from calls group by pid)
    select pid, val, hint, case when val is null or val = 0 then 'hint' when hint = 0 then 'none' when greatest(val / hint, hint / val) >= 1.5 then 'error'
    when greatest(val / hint, hint / val) >= 1.1 then 'warning' else 'ok' end as class, round((case when val > 0 then val else hint end) / 100e9 / seconds * 1e9, 6) as efficiency from c"""
)
def l12_error_class(spark, sf_dir):
    """Per processor: how far its counters are from their hints, and its efficiency in parts of 1e9."""
    sums = calls(spark, sf_dir).groupBy("pid").agg(F.sum("scalar").alias("val"), (F.sum("sse") * 6.0).alias("hint"), (F.sum(F.col("stop") - F.col("start")).cast("double") / 1000.0).alias("seconds"))
    return sums.select("pid", "val", "hint", L.error_class("val", "hint").alias("class"), F.round(L.efficiency("val", "hint", "seconds") * 1e9, 6).alias("efficiency"))


@query(f"with {LOG} select pid, msg, start - min(start) over () as ts from log")
def l16_align_clocks(spark, sf_dir):
    """Times from the first entry of all processors."""
    starts = entries(spark, sf_dir).filter("tag = 'START'")
    return L.align_clocks(starts).select("pid", "msg", "ts")


@query(f"with {LOG}, i as (select pid, min(start) as t0 from log where msg = 'signup' group by pid) select pid, start as ts, start - t0 as since from log join i using (pid) where msg = 'purchase'")
def l15_iterations(spark, sf_dir):
    """Time from each processor's first signup to each of its purchases."""
    return L.iterations(entries(spark, sf_dir).filter("tag = 'START'"), "pid", "signup", "purchase")


@query(f"with {_PAIRS} select pid, msg, occurrence, start, cast(coalesce(sum(stop - start) over (partition by pid, msg order by start, stop rows between unbounded preceding and 1 preceding), 0) as bigint) as busy from calls")
def w7_busy_timeline(spark, sf_dir):
    timeline = L.busy_timeline(L.pair(entries(spark, sf_dir)).withColumn("row", F.concat_ws("/", "pid", "msg")), "row")
    return timeline.select("pid", "msg", F.col("occurrence").cast("long").alias("occurrence"), "start", "busy")


@query(f"with {LOG} select msg, count(*) as n from log where msg not in ('view', 'error') group by msg")
def l10_kernel_filter(spark, sf_dir):
    """Entries per kernel, but for two named ones."""
    return entries(spark, sf_dir).filter("tag = 'START'").filter(~F.col("msg").isin("view", "error")).groupBy("msg").agg(F.count("*").alias("n"))


@query("select cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as bigint) as k, count(*) as n from events group by all")
def l17_properties(spark, sf_dir):
    """Events by a property of their argument text."""
    return table(spark, sf_dir, "events").groupBy(F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long").alias("k")).agg(F.count("*").alias("n"))


@query(f"with {_PAIRS} select pid, count(*) as n, round(avg(scalar / (stop - start)), 6) as per_ms from calls where stop > start group by pid")
def l19_bandwidth(spark, sf_dir):
    """Mean counter units a millisecond, by processor."""
    c = calls(spark, sf_dir).filter("stop > start")
    return c.groupBy("pid").agg(F.count("*").alias("n"), F.round(F.avg(F.col("scalar") / (F.col("stop") - F.col("start"))), 6).alias("per_ms"))


@query(f"with {LOG} select event_id as line, concat(start, ': cap ', pid, ': START [scalar=', scalar0, '] [sse=', sse0, '] ', msg) as value from log join events using (event_id)")
def l2_glue(spark, sf_dir):
    """Log lines whose message was split in three, put together again."""
    e = table(spark, sf_dir, "events")
    whole = F.format_string("%d: cap %d: START [scalar=%d] [sse=%d] %s", F.unix_millis(F.col("ts").cast("timestamp")), "user_id", F.col("event_id") % 97, F.col("event_id") % 31, "event_type")
    mark = F.concat(F.lit("[["), F.col("event_id").cast("string"), F.lit("]]"))
    cut_up = e.select("event_id", whole.alias("line"), mark.alias("mark")).select(
        F.col("event_id").cast("string").alias("log"),
        F.explode(
            F.array(
                F.struct((F.col("event_id") * 3).alias("at"), F.concat(F.substring("line", 1, 20), "mark").alias("value")),
                F.struct((F.col("event_id") * 3 + 1).alias("at"), F.concat("mark", F.substring("line", 21, 9), "mark").alias("value")),
                F.struct((F.col("event_id") * 3 + 2).alias("at"), F.concat("mark", F.expr("substring(line, 30)")).alias("value")),
            )
        ).alias("x"),
    )
    glued = L.glue(cut_up.select("log", "x.at", "x.value"))
    return glued.select((F.col("at") / 3).cast("long").alias("line"), "value")


@query(
    f"""with {_PAIRS} select pid, msg, count(*) as n, sum(scalar) as written, max(sse) as hint, cast(sum(stop - start) as bigint) as t,
    sum(case when scalar > 50 then scalar else 0 end) as large from calls group by all"""
)
def l8_io_metrics(spark, sf_dir):
    """Per processor and kernel: bytes by counter difference, the greatest hint, time, and what large transfers moved."""
    return calls(spark, sf_dir).groupBy("pid", "msg").agg(
        F.count("*").alias("n"),
        F.sum("scalar").alias("written"),
        F.max("sse").alias("hint"),
        F.sum(F.col("stop") - F.col("start")).alias("t"),
        F.sum(F.when(F.col("scalar") > 50, F.col("scalar")).otherwise(0.0)).alias("large"),
    )


_KERNELS = "case event_id % 5 when 0 then 'GridKernelCPU' when 1 then 'gridKernelCPU' when 2 then 'DegridKernelCPU' when 3 then 'ridKernelCPU' else event_type end"


@query(f"with {LOG}, k as (select {_KERNELS} as name, epoch_us(ts) // 1000 as start from events) select name as msg, count(*) as n, min(start) as first from k where substr(name, 2) in ('ridKernelCPU', 'iew') group by name")
def l10_gridders(spark, sf_dir):
    """Entries of kernels told by their name less its first letter: gridders of either case, and neither degridders nor the bare rest."""
    named = table(spark, sf_dir, "events").select(F.expr(_KERNELS).alias("msg"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return L.named_past_first(named, "ridKernelCPU", "iew").groupBy("msg").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log, at, value): four lines of each program's log, two of them alike but for their place."""
    e = table(spark, sf_dir, "events").withColumn("log", F.col("event_id"))
    listed = lambda what, *parts: F.concat(F.lit(f'capset 0: {what}: ["'), F.concat_ws('","', *parts), F.lit('"]'))
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    lines = F.array(
        F.lit("capset 0: rtsopts"),
        listed("args", F.lit("imaging"), F.concat(F.lit("--"), kind), n),
        listed("args", F.lit("later")),
        listed("env", F.concat(F.lit("KIND="), kind), F.concat(F.lit("N="), F.lit("1=2")), F.lit("no entry"), F.concat(F.lit("N="), n)),
    )
    return e.select("log", F.posexplode(lines).alias("at", "value"))


@query("select event_id as log, '--' || event_type as flag, 3::bigint as args, event_type as kind, cast(event_id as varchar) as n, 2::bigint as names from events")
def l17_launches(spark, sf_dir):
    """Arguments and environment of the programs that wrote the logs."""
    lines = launches(spark, sf_dir)
    args, env = L.program_args(lines), L.program_env(lines)
    return args.join(env, "log").select("log", F.col("values")[1].alias("flag"), F.size("values").cast("long").alias("args"), F.col("env")["KIND"].alias("kind"), F.col("env")["N"].alias("n"), F.size("env").cast("long").alias("names"))


@query(f"with {LOG} select msg, count(*) as n, cast(sum(scalar0) as double) as scalar, min(start) as first from log group by msg")
def l2_text_log(spark, sf_dir):
    """Log files written as text, read in the order of their lines, with messages that were split over lines far apart put together again."""
    e = table(spark, sf_dir, "events")
    whole = F.format_string("%d: cap %d: START [scalar=%d] [sse=%d] %s", F.unix_millis(F.col("ts").cast("timestamp")), "user_id", F.col("event_id") % 97, F.col("event_id") % 31, "event_type")
    mark = F.concat(F.lit("[["), F.col("event_id").cast("string"), F.lit("]]"))
    each = e.select("event_id", "user_id", whole.alias("line"), mark.alias("mark"))
    split = F.array(F.concat(F.substring("line", 1, 20), "mark"), F.concat("mark", F.substring("line", 21, 9), "mark"), F.concat("mark", F.expr("substring(line, 30)")))
    pieces = each.select("event_id", "user_id", F.posexplode(F.when(F.col("event_id") % 3 > 0, split).otherwise(F.array("line"))).alias("k", "value"))
    path = new_path(spark, "log")
    pieces.repartition(4, "user_id").sortWithinPartitions("k", "event_id").select("value").write.text(path)
    log = L.parse_lines(L.glue(T.read_log(spark, path), ("block", "line")).select("value"))
    return log.groupBy("msg").agg(F.count("*").alias("n"), F.sum(F.col("attrs")["scalar"]).alias("scalar"), F.min("ts").alias("first"))


def device_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg, attrs): a line per event with attributes of four families; counters carry the time that they were measured over."""
    e = table(spark, sf_dir, "events")
    k, took = F.col("event_id"), F.floor("value")
    attrs = F.format_string("[hint:ops=%d] [hint:ops=%d] [perf:sse=%d/%d] [cuda:kernel=%d] [cuda:copy=%d/%d] [cuda:flops=%d] [note=x%d] ", k % 7, k % 11, k % 31, took + 1, took, k % 5, k % 13, k % 97, k % 3)
    return e.select(F.col("event_type").alias("msg"), L.text_attributes(attrs).alias("attrs"))


_DEVICE = "d as (select event_type as msg, event_id as k, cast(floor(value) as bigint) as took from events)"


@query(
    f"""with {_DEVICE}, f as (select unnest([{{'family': 'hint', 'name': 'ops', 'value': k % 11, 'time': null}}, {{'family': 'perf', 'name': 'sse', 'value': k % 31, 'time': took + 1}},
    {{'family': 'cuda', 'name': 'kernel', 'value': took, 'time': null}}, {{'family': 'cuda', 'name': 'copy', 'value': k % 5, 'time': k % 13}},
    {{'family': 'cuda', 'name': 'flops', 'value': k % 97, 'time': null}}, {{'family': null, 'name': 'note', 'value': null, 'time': null}}]) as x from d)
    select x.family, x.name, count(*) as n, cast(sum(x.value) as double) as total, cast(sum(x.time) as double) as t from f group by all"""
)
def l3_attribute_families(spark, sf_dir):
    """Attributes by family and name, with the sums of their values and times; the last hint of a name holds."""
    each = device_lines(spark, sf_dir).select(F.explode(L.counter_families(F.col("attrs"))).alias("x"))
    return each.groupBy("x.family", "x.name").agg(F.count("*").alias("n"), F.sum("x.value").alias("total"), F.sum("x.time").alias("t"))


@query(
    f"""with {_DEVICE} select msg, count(*) as n, cast(sum(took) as double) as kernel_time, cast(sum(k % 13) as double) as transfer_time, cast(sum(k % 5) as double) as transferred,
    cast(sum(k % 97) as double) as flops, round(case when sum(took) > 0 then cast(sum(k % 97) as double) / sum(took) * 1e9 end, 3) as rate from d group by msg"""
)
def l7_device_metrics(spark, sf_dir):
    """Device time, copies and operation rate per kernel."""
    found = F.col("counters")
    of = lambda name, part: F.element_at(F.filter(found, lambda x: (x["family"] == "cuda") & (x["name"] == name)), 1)[part]
    calls = device_lines(spark, sf_dir).select("msg", L.counter_families(F.col("attrs")).alias("counters"))
    named = calls.select("msg", of("kernel", "value").alias("kernel_time"), of("copy", "time").alias("transfer_time"), of("copy", "value").alias("transferred"), of("flops", "value").alias("flops"))
    return L.device_metrics(named).withColumn("rate", F.round("rate", 3))
