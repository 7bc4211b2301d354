"""START and END lines of a log that arrives over time, paired as ``logs.pair`` pairs a whole log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CALLS = "pid long, msg string, occurrence long, start timestamp, stop timestamp"
STATE = "n long, starts array<long>, stops array<long>"


def pair_stream(lines: DataFrame, late: str = "10 minutes", expire: str = "1 hour") -> DataFrame:
    """(pid, msg, occurrence, start, stop) of a stream of lines (ts, pid, tag, msg): the nth START of a message on a processor with its nth END
    in the order of time, whatever the order of arrival.

    A line is settled when the watermark, ``late`` behind the latest line, has passed it: no earlier one can come then. Settled
    lines pair up; one that finds none within ``expire`` of the watermark goes with a null side. So the state of a processor's
    message is what came in within both times. Lines later than the watermark are left out, as streams do."""
    keep = int(pd.Timedelta(expire).total_seconds() * 1_000_000)

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, starts, stops = state.get if state.exists else (0, [], [])
        starts, stops = list(starts), list(stops)
        for b in batches:
            micros = b["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            starts += micros[(b["tag"] == "START").to_numpy()].tolist()
            stops += micros[(b["tag"] == "END").to_numpy()].tolist()
        starts.sort()
        stops.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        out = []
        while starts or stops:
            a, b = starts[0] if starts else None, stops[0] if stops else None
            if a is not None and b is not None and a < mark and b < mark:
                out.append((starts.pop(0), stops.pop(0)))
            elif (a if a is not None else b) < mark - keep and (a is None or b is None):
                out.append((starts.pop(0) if starts else None, stops.pop(0) if stops else None))
            else:
                break
        rows = [(*key, n + i + 1, pd.Timestamp(a, unit="us") if a is not None else pd.NaT, pd.Timestamp(b, unit="us") if b is not None else pd.NaT) for i, (a, b) in enumerate(out)]
        if starts or stops:
            state.update((n + len(out), starts, stops))
            first = min([*starts[:1], *stops[:1]])
            alone = not starts or not stops
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (max([*starts[:1], *stops[:1]]) if not alone else first + keep) // 1000 + 1))
        elif rows or state.exists:
            state.update((n + len(out), [], []))
        yield pd.DataFrame(rows, columns=["pid", "msg", "occurrence", "start", "stop"])

    ends = lines.filter(F.col("tag").isin("START", "END")).select("ts", "pid", "tag", "msg").withWatermark("ts", late)
    return ends.groupBy("pid", "msg").applyInPandasWithState(settle, CALLS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
