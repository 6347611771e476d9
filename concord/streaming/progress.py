"""Progress events per job, reduced to a state that never falls.

One event is one transition of a job's state; the batch form runs a job's events in order, the stream form keeps the state
by key.  Events: ev, seq, ts, units (array of key), key, parts, index, done, total, ok.

State: ``left`` (keys of units that are not over, in order), ``failed`` / ``over`` (how many ended badly, or at all), ``size``
(units planned), ``now`` (the unit at work with its counters, or null), ``peak`` (the highest fraction so far), ``seq``, ``last``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT_SCHEMA = "job string, ev string, seq long, ts double, units array<string>, key string, parts int, index int, done int, total int, ok boolean"
SNAPSHOT_SCHEMA = "job string, seq long, n_units int, finished int, failed int, current string, fraction double, last_ts double"


def new_state() -> dict:
    return {"left": [], "failed": 0, "over": 0, "size": 0, "now": None, "peak": 0.0, "seq": 0, "last": None}


def _count(event: dict, field: str, missing: int = 0) -> int:
    """A counter of an event; what is missing or no finite number has the default."""
    value = event.get(field)
    return int(value) if isinstance(value, (int, float)) and math.isfinite(value) else missing


def _planned(state: dict, event: dict) -> None:
    units = event.get("units")
    keys = list(dict.fromkeys(u for u in ([] if units is None else units) if u))
    state.update(left=keys, size=len(keys), failed=0, over=0, now=None, peak=0.0)


def _started(state: dict, event: dict) -> None:
    if event.get("key") in state["left"]:
        state["now"] = {"key": event["key"], "parts": max(1, _count(event, "parts", 1)), "part": 0, "done": 0, "total": 0}


def _moved(state: dict, event: dict) -> None:
    now = state["now"]
    if now and event.get("key") == now["key"]:
        if event["ev"] == "part":
            now.update(part=_count(event, "index"), done=0, total=0)
        else:
            now.update(done=_count(event, "done"), total=_count(event, "total"))


def _ended(state: dict, event: dict) -> None:
    key = event.get("key")
    if key in state["left"]:
        state["left"].remove(key)
        state["over"] += 1
        state["failed"] += event.get("ok") is False
        if state["now"] and state["now"]["key"] == key:
            state["now"] = None


def _closed(state: dict, event: dict) -> None:
    """All that is left ends: the unit at work as failed, the others as skipped."""
    state["failed"] += state["now"] is not None
    state["over"] += len(state["left"])
    state.update(left=[], now=None)


_TRANSITIONS: dict[str, Callable[[dict, dict], None]] = {"plan": _planned, "unit_start": _started, "part": _moved, "step": _moved, "unit_done": _ended, "finish_remaining": _closed}


def advance(state: dict, event: dict) -> dict:
    """The state after one event.  A plan starts anew, a unit that is over stays over, and an event for another unit than the
    one at work, or of no known kind, changes nothing but the clock."""
    stamp = event.get("ts")
    if isinstance(stamp, (int, float)) and math.isfinite(stamp) and stamp:
        state["last"] = stamp
    state["seq"] = max(state["seq"], _count(event, "seq"))
    change = _TRANSITIONS.get(event.get("ev"))
    if change:
        change(state, event)
        state["peak"] = max(state["peak"], progress(state))
    return state


def progress(state: dict) -> float:
    """Units that are over plus the share of the one at work, of all units: its parts before the current one, and the current
    one's steps."""
    if not state["size"]:
        return 0.0
    now, share = state["now"], 0.0
    if now:
        steps = now["done"] / now["total"] if now["total"] > 0 else 0.0
        share = (max(now["part"] - 1, 0) + sorted((0.0, steps, 1.0))[1]) / now["parts"]
    return min(1.0, (state["over"] + min(share, 1.0)) / state["size"])


def snapshot(job: str, state: dict) -> dict:
    current = state["now"]["key"] if state["now"] else None
    return {"job": job, "seq": state["seq"], "n_units": state["size"], "finished": state["over"], "failed": state["failed"], "current": current, "fraction": round(state["peak"], 6), "last_ts": state["last"]}


def _replay(state: dict, events: pd.DataFrame) -> dict:
    ordered = events.sort_values("seq", kind="stable").astype(object)
    for event in ordered.where(ordered.notna(), None).to_dict("records"):
        advance(state, event)
    return state


def fold_batch(events: DataFrame) -> DataFrame:
    """The last snapshot of each job, its events in order of seq."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([snapshot(pdf["job"].iloc[0], _replay(new_state(), pdf))])

    return events.groupBy("job").applyInPandas(run, SNAPSHOT_SCHEMA)


class _Progress(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        state = json.loads(self.state.get()[0]) if self.state.exists() else new_state()
        _replay(state, pd.concat(list(rows)))
        self.state.update((json.dumps(state),))
        yield pd.DataFrame([snapshot(key[0], state)])

    def close(self) -> None:
        """Nothing is held open."""


def fold_stream(events: DataFrame) -> DataFrame:
    """A snapshot of each job that had events in the micro-batch; state is kept per job (needs the RocksDB state store)."""
    return events.groupBy("job").transformWithStateInPandas(_Progress(), SNAPSHOT_SCHEMA, "Update", "None")


def read_events(lines: DataFrame, job: str = "job") -> DataFrame:
    """Events of JSON lines (job, value); broken lines are dropped."""
    fields = EVENT_SCHEMA.removeprefix("job string, ")
    parsed = lines.select(job, F.from_json("value", fields + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.where("e._bad is null and e.ev is not null").select(F.col(job).alias("job"), "e.*").drop("_bad")


def write_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, null fields left out; a stream appends with a checkpoint beside its files."""
    if not events.isStreaming:
        events.write.mode("append").partitionBy("job").json(path)
        return
    writer = events.writeStream.partitionBy("job").format("json").option("path", path).option("checkpointLocation", f"{path.rstrip('/')}/_checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


WATCH_SCHEMA = "job string, change string, at double, idle double"


class _Watch(StatefulProcessor):
    """Stalls and expiry of jobs by event-time timers: a timer stands where the job, were it silent, would count as stalled, or, after
    its last event, where it expires."""

    def __init__(self, stall: float, keep: float) -> None:
        self.stall, self.keep = stall, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "last double, stalled boolean, final boolean, timer long")

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job", "change", "at", "idle"])

    def _set(self, last: float, stalled: bool, final: bool, old: int | None) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        timer = None if stalled and not final else math.ceil((last + (self.keep if final else self.stall)) * 1000)
        if timer is not None:
            self.handle.registerTimer(timer)
        self.state.update((last, stalled, final, timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        last, stalled, final, timer = self.state.get() if self.state.exists() else (None, False, False, None)
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "final"], kind="stable")
        for at, ends in zip(events["ts"].astype("int64") / 1e9, events["final"], strict=True):
            if last is not None and not final and not stalled and at - last >= self.stall:
                out.append((key[0], "stalled", last + self.stall, self.stall))
                stalled = True
            if stalled and (last is None or at > last):
                out.append((key[0], "moving", at, at - last))
                stalled = False
            if bool(ends) and not final:
                final = True
                out.append((key[0], "final", at, 0.0))
            last = at if last is None else max(last, at)
        self._set(last, stalled, final, timer)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, _, final, _ = self.state.get()
        if final:
            self.state.clear()
            yield self._rows([(key[0], "expired", last + self.keep, self.keep)])
        else:
            self.state.update((last, True, False, None))
            yield self._rows([(key[0], "stalled", last + self.stall, self.stall)])

    def close(self) -> None:
        """Nothing is held open."""


def watch_stream(events: DataFrame, stall: float, keep: float) -> DataFrame:
    """(job, change, at, idle): what happens to jobs of a stream of (job, ts timestamp, final boolean) with a watermark on ``ts``.

    ``stalled`` when nothing comes for ``stall`` seconds of event time, ``moving`` when something comes after that, ``final`` at the
    event that ends the job, ``expired`` when that is ``keep`` seconds ago; then the job's state is dropped.  Silence is noticed
    when the watermark has passed it, also if the job itself never speaks again (needs the RocksDB state store).
    """
    return events.groupBy("job").transformWithStateInPandas(_Watch(stall, keep), WATCH_SCHEMA, "Append", "EventTime")


def watch_batch(events: DataFrame, stall: float, keep: float, now: float | None = None) -> DataFrame:
    """What ``watch_stream`` tells of finished input whose watermark ends at ``now`` (seconds; none: it never ends)."""
    of = Window.partitionBy("job").orderBy("at", "final")
    rows = events.select("job", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.coalesce("final", F.lit(False)).alias("final"))
    over = F.max(F.col("final").cast("int")).over(of.rowsBetween(Window.unboundedPreceding, -1)) == 1
    marked = rows.withColumn("before", F.lag("at").over(of)).withColumn("over", F.coalesce(over, F.lit(False)))
    gap = ~F.col("over") & (F.col("at") - F.col("before") >= stall)
    change = lambda name, at, idle: F.struct(F.lit(name).alias("change"), at.alias("at"), idle.cast("double").alias("idle"))
    seen = marked.select("job", F.explode(F.array_compact(F.array(
        F.when(gap, change("stalled", F.col("before") + stall, F.lit(stall))),
        F.when(gap, change("moving", F.col("at"), F.col("at") - F.col("before"))),
        F.when(F.col("final") & ~F.col("over"), change("final", F.col("at"), F.lit(0.0))),
    ))).alias("c")).select("job", "c.*")
    if now is None:
        return seen
    ends = rows.groupBy("job").agg(F.max("at").alias("last"), F.bool_or("final").alias("ended"))
    late = ends.select("job", F.when(F.col("ended"), change("expired", F.col("last") + keep, F.lit(keep))).otherwise(change("stalled", F.col("last") + stall, F.lit(stall))).alias("c"))
    return seen.unionByName(late.select("job", "c.*").where(F.col("at") <= now))
