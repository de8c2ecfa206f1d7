"""Peaks, keyframes and intervals on streams whose rows come late or out of order.

Rows of a key wait in the state until the watermark has passed them, and are then
gone through in the order of time and frame, so the result is that of the batch
query over all rows that were not late, however they were dealt to micro-batches.
What is kept besides is bounded: the last two values and the last peak, or the open
interval, which a timer closes.  Rows behind the watermark are dropped, as they are
by every operator with one; rows with a null key or time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (state, row or None at a timer, watermark in microseconds) to (state, rows to emit, when to look again in microseconds or None).
Step = Callable[[dict | None, tuple | None, int], tuple[dict | None, list, int | None]]


class InOrder(StatefulProcessor):
    """Calls a step for the rows of a key in order once they cannot be overtaken any more."""

    def __init__(self, keys: list[str], names: list[str], step: Step):
        self.keys, self.names, self.step = keys, names, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")
        self.waiting = handle.getListState("waiting", "t bigint, frame bigint, value double, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for b in rows:
            columns = (b["t"].tolist(), b["frame"].tolist(), [None if pd.isna(v) else float(v) for v in b["value"]], [None if pd.isna(x) else x for x in b["text"]])
            new += list(zip(*columns, strict=True))
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        out, again = [], None
        for r in [*due, None]:
            state, found, again = self.step(state, r, now)
            out += found
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
        if again is not None:
            self._wake(again)
        if out:
            frame = pd.DataFrame(out, columns=self.names)
            for name, value in reversed(list(zip(self.keys, key, strict=True))):
                frame.insert(0, name, value)
            yield frame

    def _wake(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, keys: list[str], late: str, value, text, step: Step, names: list[str], kinds: str) -> DataFrame:
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)  # the only one that keeps lists and timers
    ts = F.col("ts").cast("timestamp")
    known = ts.isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    r = rows.where(known).withColumn("ts", ts).withWatermark("ts", late)
    r = r.select(*keys, "ts", F.unix_micros("ts").alias("t"), F.col("frame").cast("long").alias("frame"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    types = dict(r.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + kinds
    return r.groupBy(*keys).transformWithStateInPandas(InOrder(keys, names, step), schema, "Append", "EventTime")


def peak_step(threshold: float) -> Step:
    """Peaks that exceed both neighbours by `threshold`, and the keyframe between each and the one before."""

    def step(state, row, now):
        if row is None:
            return state, [], None
        s = state or {"pos": 0, "a": None, "b": None, "frame": None, "peak": 0}
        _, frame, c, _ = row
        a, b, out = s["a"], s["b"], []
        if s["pos"] >= 2 and None not in (a, b, c) and b > a and b > c and b - a >= threshold and b - c >= threshold:
            at = s["pos"] - 1
            out.append((s["frame"], at, b, (at + s["peak"]) // 2))
            s = s | {"peak": at}
        return s | {"pos": s["pos"] + 1, "a": b, "b": c, "frame": frame}, out, None

    return step


def stream_peaks(series: DataFrame, threshold: float, late: str = "30 minutes") -> DataFrame:
    """From a stream (video, ts, frame, ratio): video, frame, pos, ratio and keyframe of every peak.

    pos counts the rows of a video by time; the keyframe is the middle between the
    peak and the one before, 0 before the first.
    """
    return _in_order(series, ["video"], late, F.col("ratio"), F.lit(None), peak_step(threshold), ["frame", "pos", "ratio", "keyframe"], "frame long, pos long, ratio double, keyframe long")


def interval_step(gap: int) -> Step:
    """Intervals that end when `gap` microseconds bring no row; sources are joined as the batch form does."""

    def step(state, row, now):
        out = []
        if state and (row[0] - state["last"] >= gap if row else now - state["last"] >= gap):
            out.append((state["start"], state["last"], state["n"], state["source"]))
            state = None
        if row:
            t, _, _, source = row
            source = "unknown" if source is None else source
            if state is None:
                state = {"start": t, "last": t, "n": 1, "source": source}
            else:
                state = state | {"last": t, "n": state["n"] + 1}
                if state["source"] != source:
                    state["source"] += f", {source}"
        return state, out, state["last"] + gap if state else None

    return step


def stream_intervals(detections: DataFrame, gap_seconds: float = 600.0, late: str = "30 minutes") -> DataFrame:
    """From a stream (video, brand, ts, frame, source): video, brand, start, stop, n and source of every interval that has ended."""
    named = detections.where(F.coalesce("brand", F.lit("UNKNOWN")) != "UNKNOWN")
    out = _in_order(named, ["video", "brand"], late, F.lit(None), F.col("source"), interval_step(int(gap_seconds * 1e6)), ["start", "stop", "n", "source"], "start long, stop long, n long, source string")
    return out.select("video", "brand", F.timestamp_micros("start").alias("start"), F.timestamp_micros("stop").alias("stop"), "n", "source")
