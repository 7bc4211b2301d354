"""SQL of the derived tables, for the DuckDB side of the registered queries."""

from __future__ import annotations

VIS = """vis as (select l_orderkey * 8 + l_linenumber as vis_id, l_suppkey % 16 as bl, l_orderkey % 200 as t,
    cast((l_partkey * 37 + l_orderkey * 11 + l_linenumber * 101) % 4096 - 2048 as double) / 16.0 as u,
    cast((l_partkey * 53 + l_orderkey * 29 + l_linenumber * 211) % 4096 - 2048 as double) / 16.0 as v,
    cast((l_orderkey * 17 + l_linenumber * 5) % 401 - 200 as double) as w,
    cast(l_orderkey % 7 - 3 as double) as re, cast(l_partkey % 5 - 2 as double) as im from lineitem)"""

GCF = """gcf as (select *, ((su * 3 + sv * 5 + ou + ov) % 8 + 1) / 16.0 as gr, ((su + 2 * sv + ou) % 4 - 1) / 16.0 as gi
    from (select i // 512 as ou, i // 64 % 8 as ov, i // 8 % 8 as su, i % 8 as sv from range(4096) r(i)))"""


def pregrid(grid: int = 256, size: int = 8, source: str = "vis") -> str:
    at = lambda c: f"cast(round_even({c}, 0) as integer) + {grid // 2 - size // 2}"
    off = lambda c: f"greatest(0, least(7, cast(round_even(8 * ({c} - floor({c})), 0) as integer)))"
    return f"pre as (select *, {at('u')} as x, {at('v')} as y, {off('u')} as ou, {off('v')} as ov from {source})"


def inside(grid: int = 256, size: int = 8) -> str:
    return f"pts as (select * from pre where x between 0 and {grid - size - 1} and y between 0 and {grid - size - 1})"


def grid(re: str = "re", im: str = "im", keys: str = "") -> str:
    return f"""grid as (select {keys} x + su as x, y + sv as y, sum({re} * gr - {im} * gi) as gre, sum({re} * gi + {im} * gr) as gim, count(*) as n
    from pts join gcf using (ou, ov) group by all)"""


def gridded(size: int = 256, re: str = "re", im: str = "im") -> str:
    """All that a query needs to read from grid."""
    return ",\n".join((VIS, GCF, pregrid(size), inside(size), grid(re, im)))


LOG = """log as (select event_id, user_id as pid, event_type as msg, epoch_us(ts) // 1000 as start, epoch_us(ts) // 1000 + 1 + cast(floor(value) as bigint) as stop,
    event_id % 97 as scalar0, event_id % 97 + cast(floor(value) as bigint) as scalar1, event_id % 31 as sse0, event_id % 31 + 5 as sse1 from events)"""
