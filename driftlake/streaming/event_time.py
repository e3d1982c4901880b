"""Detectors over streams whose rows come out of order.

Rows wait in list state until the watermark has passed their time; then a timer hands them on in the order of (ts, seq),
over all micro-batches, so that a stream gives what the table gives however its rows were dealt out. A row that comes when a
later one of its series has been handed on, or that has no time, cannot be put in its place: it comes out marked `late`,
with a null result, and changes nothing. None is dropped: the watermark moves timers only, as the event time that Spark
would filter by is not passed on to the state.

A row whose series is null is a sign of life: it moves the watermark and comes out nowhere. Rows without a finite value are
handed on like others; detectors skip them. Needs the RocksDB state store (`ROCKS`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlake.streaming.detectors import ALERT, DAYS, HOURS, RESULT, SEVERITY, STUDY_ALERT, Detector, _agreement, severity_of

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
Take = Callable[[dict, str, pd.DataFrame], pd.DataFrame]


class InEventTime(StatefulProcessor):
    """Hands a series' rows on in order. take(state, series, rows) changes the state, which JSON can hold, and gives what
    comes out; rows are (seq, at, value, site) in order, `at` in microseconds."""

    def __init__(self, start: Callable[[], dict], take: Take, names: list[str], seeded: Callable[..., dict] | None = None):
        self.start, self.take, self.names, self.seeded = start, take, names, seeded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, at long, seq long, timer long")
        self.waiting = handle.getListState("waiting", "seq long, at long, value double, site string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        n, mean, m2 = initialState[["n", "mean", "m2"]].iloc[0].tolist()
        self.held.update((json.dumps(self.seeded(int(n), float(mean), float(m2))), -(1 << 62), 0, 1 << 62))

    def _state(self) -> tuple[str | None, int, int, int]:
        return tuple(self.held.get()) if self.held.exists() else (None, -(1 << 62), 0, 1 << 62)

    def _timer(self, at: int, before: int) -> int:
        """Wakes up when the watermark has passed a time, unless it will before."""
        when = -(-at // 1000)
        if when < before:
            self.handle.registerTimer(when)
        return min(when, before)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        if key[0] is None or pd.isna(key[0]):
            return
        state, at, seq, timer = self._state()
        time = new["at"].to_numpy(float, na_value=np.nan)
        new = new.assign(at=new["at"].fillna(0).astype("int64"), site=new["site"].astype(object).where(new["site"].notna(), None))
        late = np.isnan(time) | (new["at"] < at).to_numpy() | ((new["at"] == at) & (new["seq"] < seq)).to_numpy()
        in_time = new[~late]
        if len(in_time):
            self.waiting.appendList(list(in_time[["seq", "at", "value", "site"]].itertuples(index=False, name=None)))
            self.held.update((state, at, seq, self._timer(int(in_time["at"].min()), timer)))
        if late.any():
            own = new[late]
            yield self._out(key, pd.DataFrame({"seq": own["seq"], "ts": pd.to_datetime(own["at"], unit="us").where(~np.isnan(time[late]))}), True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        state, at, seq, _ = self._state()
        rows = pd.DataFrame(list(self.waiting.get()), columns=["seq", "at", "value", "site"])
        due = rows[rows["at"] <= passed].sort_values(["at", "seq"], kind="stable")
        rest = rows[rows["at"] > passed]
        if len(rest):
            self.waiting.put(list(rest.itertuples(index=False, name=None)))
        else:
            self.waiting.clear()
        own = json.loads(state) if state else self.start()
        out = self.take(own, str(key[0]), due) if len(due) else None
        if len(due):
            at, seq = int(due["at"].iloc[-1]), int(due["seq"].iloc[-1])
        self.held.update((json.dumps(own), at, seq, self._timer(int(rest["at"].min()), 1 << 62) if len(rest) else 1 << 62))
        if out is not None and len(out):
            yield self._out(key, out, False)

    def _out(self, key: tuple, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        n = len(rows)
        own = {"series": np.array([str(key[0])] * n, object), "late": np.full(n, late)}
        return pd.DataFrame({c: own[c] if c in own else rows[c].to_numpy() if c in rows else np.full(n, None, object) for c in self.names})

    def close(self) -> None:
        pass


def in_event_time(stream: DataFrame, start: Callable[[], dict], take: Take, schema: str, lateness: str, seeds: DataFrame | None = None, seeded: Callable[..., dict] | None = None) -> DataFrame:
    """What take makes of each series' rows (series, seq, ts, value[, site]) in the order of time, with a column `late` after
    those of schema. lateness: how far behind the latest row of the stream another may be and still be put in its place.
    seeds: moments of each series (n, mean, m2) that seeded makes its first state from."""
    schema = f"{schema}, late boolean"
    site = F.col("site").cast("string") if "site" in stream.columns else F.lit(None).cast("string")
    rows = stream.select(F.col("series").cast("string").alias("series"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("_time"), F.col("value").cast("double").alias("value"), site.alias("site"))
    # `at` is no event time to Spark, so it drops no row by it
    rows = rows.withWatermark("_time", lateness).select("series", "seq", F.unix_micros("_time").alias("at"), "value", "site")
    work = InEventTime(start, take, [c.split()[0] for c in schema.split(", ")], seeded)
    first = None if seeds is None else seeds.select("series", "n", "mean", "m2").groupBy("series")
    return rows.groupBy("series").transformWithStateInPandas(work, schema, "append", "eventTime", first)


def detected(stream: DataFrame, detector: Detector, lateness: str = "1 day", seeds: DataFrame | None = None) -> DataFrame:
    """A detector's result after each finite row, as `replayed` gives for a table. seeds: `detectors.moments` of the past."""

    def take(state: dict, series: str, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[np.isfinite(rows["value"].to_numpy(float))]
        seen = detector.steps(state, rows["value"].to_numpy(float))
        return pd.DataFrame({"seq": rows["seq"].to_numpy(), "ts": pd.to_datetime(rows["at"].to_numpy(), unit="us"), **dict(zip(("detected", "probability", "magnitude", "direction"), seen))})

    return in_event_time(stream, detector.start, take, RESULT, lateness, seeds, detector.seeded)


def alerted(stream: DataFrame, detector: Detector, cooldown: timedelta = HOURS, least: str = "watch", lateness: str = "1 day") -> DataFrame:
    """Alerts with a cooldown, as `alerts` gives for a table."""
    pause = round(cooldown / timedelta(microseconds=1))

    def take(state: dict, series: str, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[np.isfinite(rows["value"].to_numpy(float))]
        hit, probability, _, way = detector.steps(state["d"], rows["value"].to_numpy(float))
        out = []
        for k in np.flatnonzero(hit).tolist():  # hits are few
            at, severity = int(rows["at"].iloc[k]), severity_of(probability[k])
            if SEVERITY[severity] >= SEVERITY[least] and (state["last"] is None or at >= state["last"] + pause):
                state["last"] = at
                out.append((int(rows["seq"].iloc[k]), pd.Timestamp(at, unit="us"), severity, way[k]))
        return pd.DataFrame(out, columns=["seq", "ts", "severity", "direction"])

    return in_event_time(stream, lambda: {"d": detector.start(), "last": None}, take, ALERT, lateness)


def agreed(stream: DataFrame, detector: Detector, window: timedelta = DAYS, least_sites: int = 2, cooldown: timedelta = HOURS, pause: timedelta = HOURS, sites: set[str] | None = None, lateness: str = "1 day") -> DataFrame:
    """Study alerts of rows (series, seq, ts, site, value), as `concordance` gives for a table."""
    start, step = _agreement(detector, window, least_sites, cooldown, pause, sites)
    stamp = lambda x: None if x is None else x.isoformat()
    time = lambda x: None if x is None else datetime.fromisoformat(x)

    def take(state: dict, series: str, rows: pd.DataFrame) -> pd.DataFrame:
        s, out = {"last": time(state["last"]), "sites": {k: {"d": v["d"], "last": time(v["last"])} for k, v in state["sites"].items()}}, []
        for seq, at, x, site in rows.itertuples(index=False, name=None):
            ts = pd.Timestamp(at, unit="us").to_pydatetime()
            near = step(s, site, ts, x)
            if near is not None:
                out.append((seq, ts, float(near)))
        state.update({"last": stamp(s["last"]), "sites": {k: {"d": v["d"], "last": stamp(v["last"])} for k, v in s["sites"].items()}})
        return pd.DataFrame(out, columns=["seq", "ts", "value"])

    return in_event_time(stream, start, take, STUDY_ALERT, lateness)
