"""Dwell alerts and equipment memory on streams of observations, by keyed state.

An observation is (track_id, ts_us, in_zone, worn) and, where incidents can be resolved, closes, with the
event time `ts` that ts_us is in microseconds. Rows wait in their track's buffer until the watermark has passed
them, and then go through the state machine in time order. So rows may come in any order within the lateness, over
any number of batches, and give what the batch operators give; beyond it the watermark drops them. State per
track: the last time, when each required class was last seen, and the open incident. A timer at the next
waiting row, or at the end of grace and memory, clears a track, so state is bounded by the tracks that
are about. People without a track are no track: they are counted, and never take part in incidents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

OUT = "track_id long, started_us long, fired_us long, missing array<int>"
_CLASSES = ArrayType(IntegerType())


class DwellProcessor(StatefulProcessor):
    def __init__(self, dwell: int, grace: int, memory: int, required: tuple[int, ...]):
        self.dwell, self.grace, self.memory, self.required = dwell, grace, memory, required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        times = ["last", "timer", "start", "until", *(f"seen_{c}" for c in self.required)]
        self.state = handle.getValueState("track", StructType([StructField(c, LongType()) for c in times] + [StructField("fired", BooleanType()), StructField("missing", _CLASSES)]))
        self.waiting = handle.getListState("waiting", StructType([StructField("ts_us", LongType()), StructField("in_zone", BooleanType()), StructField("worn", _CLASSES), StructField("closes", BooleanType())]))

    def _held(self) -> list:
        got = self.state.get()
        return list(got) if got else [None] * (6 + len(self.required))

    def _wake(self, held: list, at: int) -> None:
        """One timer for each track, at the earliest of what it waits for."""
        if held[1] is not None:
            self.handle.deleteTimer(held[1])
        held[1] = at
        self.handle.registerTimer(at)
        self.state.update(tuple(held))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            closes = frame["closes"] if "closes" in frame else [False] * len(frame)
            for ts, inside, worn, c in zip(frame["ts_us"], frame["in_zone"], frame["worn"], closes):
                new.append((int(ts), bool(inside), [] if worn is None else [int(x) for x in worn], bool(c)))
        self.waiting.appendList(new)
        held, first = self._held(), -(-min(r[0] for r in new) // 1000)
        # a timer for the end of a track is set anew when rows have gone through
        if held[1] is None or first < held[1]:
            self._wake(held, first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[0])
        due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        held = self._held()
        held[1] = None  # it has just expired
        out = self._through(key[0], held, due)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        ends = None if held[0] is None else (held[0] + max(self.grace, self.memory)) // 1000 + 1
        if rest:
            self._wake(held, -(-rest[0][0] // 1000))
        elif ends is not None and ends * 1000 > passed:
            self._wake(held, ends)
        else:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["track_id", "started_us", "fired_us", "missing"])

    def _through(self, track, held: list, rows: list) -> list[tuple]:
        """The state machine over rows in time order; held changes in place."""
        last, timer, start, until, *seen, fired, missing = held
        seen, out = dict(zip(self.required, seen)), []
        for now, inside, worn, closes in rows:
            last = now
            seen |= {int(c): now for c in worn or [] if int(c) in seen}
            if closes:
                start = missing = None
                continue
            lacks = [c for c, at in seen.items() if at is None or now - at > self.memory]
            if not inside or not lacks:
                continue
            if start is None or now - until > self.grace:
                start, fired = now, False
            until, missing = now, lacks
            if not fired and now - start >= self.dwell:
                fired = True
                out.append((track, start, now, lacks))
        held[:] = [last, timer, start, until, *seen.values(), fired, missing]
        return out

    def close(self) -> None:
        pass


def alert_stream(observed: DataFrame, dwell: int, grace: int, memory: int, required: tuple[int, ...] = (1, 2), late: str = "10 seconds") -> DataFrame:
    """observed: a streaming frame with ts (timestamp) and the observation columns. A row with `closes` ends its track's open
    incident at once. Alerts in append mode, as soon as the watermark has passed the row that fires."""
    marked = observed.withWatermark("ts", late).filter("track_id is not null")
    # a row outside with nothing worn changes no incident; it moves the watermark (naming ts keeps the filter above it), and then goes
    tells = F.col("in_zone") | (F.size("worn") > 0) | F.col("ts").isNull()
    if "closes" in observed.columns:
        tells = tells | F.col("closes")
    marked = marked.filter(tells)
    return marked.groupBy("track_id").transformWithStateInPandas(DwellProcessor(dwell, grace, memory, required), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def frame_alerts(detections: DataFrame, points: list[tuple[float, float]], dwell: int, grace: int, memory: int, required: tuple[int, ...] = (1, 2), late: str = "10 seconds") -> DataFrame:
    """The whole plan of a frame, from detections to alerts: duplicate people go, equipment is bound, people are judged against
    the zone of these points, and dwell and memory decide what fires.

    detections: a streaming frame of one row per frame with ts, ts_us, frame and boxes, an array of struct<box_idx, cls, xc, yc,
    w, h, track_id>. A frame is one row, so nothing is shuffled until alerts are keyed by track.
    """
    from ..functions import polygon as P
    from ..operators.frames import judged

    people = judged(detections, lambda x, y: P.inside(points, x, y))
    return alert_stream(people.select("ts", "ts_us", "track_id", "in_zone", "worn"), dwell, grace, memory, required, late)


COUNTS = ("frames", "people", "alerts", "untracked")


class CountProcessor(StatefulProcessor):
    """Running sums of a key's counts, and how often they were updated."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", StructType([StructField(c, LongType()) for c in (*COUNTS, "updates")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums = list(self.sums.get() or (0,) * (len(COUNTS) + 1))
        for frame in rows:
            for i, c in enumerate(COUNTS):
                sums[i] += int(frame[c].sum())
        sums[-1] += 1
        self.sums.update(tuple(sums))
        yield pd.DataFrame([(*key, *sums)], columns=["zone", "shard", *COUNTS, "updates"])

    def close(self) -> None:
        pass


def counted(frames: DataFrame, alerts: DataFrame, shards: int = 8) -> DataFrame:
    """Running counts for each zone of frames, people, alerts and untracked violations, exactly: each frame and each alert counts once.

    frames: a stream of one row per frame and zone: zone, frame, people, untracked (counts); alerts: a stream of
    alerts with their zone. The alerts' state and these counts are two stateful operators of one query, in append mode. A
    zone's rows are dealt over `shards` keys, so that a busy zone is not one task; totals() adds their newest rows up.
    """
    zero = lambda *cs: [F.lit(0).cast("long").alias(c) for c in cs]
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int").alias("shard")
    one = F.lit(1).cast("long")
    seen = frames.select("zone", shard("frame"), one.alias("frames"), F.col("people").cast("long").alias("people"), *zero("alerts"), F.col("untracked").cast("long").alias("untracked"))
    fired = alerts.select("zone", shard("track_id"), *zero("frames", "people"), one.alias("alerts"), *zero("untracked"))
    kind = "zone string, shard int, " + ", ".join(f"{c} long" for c in (*COUNTS, "updates"))
    return seen.unionByName(fired).groupBy("zone", "shard").transformWithStateInPandas(CountProcessor(), outputStructType=kind, outputMode="Append", timeMode="None")


def totals(counts: DataFrame) -> DataFrame:
    """(zone, frames, people, alerts, untracked) as of now, from all that counted() has given so far."""
    newest = counts.groupBy("zone", "shard").agg(F.max_by(F.struct(*COUNTS), "updates").alias("s"))
    return newest.groupBy("zone").agg(*(F.sum(f"s.{c}").alias(c) for c in COUNTS))


def open_incidents(spark: SparkSession, checkpoint: str, grace: int, as_of_us: int | None = None, operator: int = 0) -> DataFrame:
    """(track_id, started_us, last_us, fired, missing) of the incidents that are open in a running or stopped query of
    alert_stream(), read from its checkpoint's state as of the last committed batch, without touching the query.

    as_of_us: an incident whose last row is more than grace before it has ended, though no row has said so yet.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", "track").load()
    v = F.col("value")
    found = state.filter(v["start"].isNotNull()).select(F.col("key.track_id").alias("track_id"), v["start"].alias("started_us"), v["until"].alias("last_us"), v["fired"].alias("fired"), v["missing"].alias("missing"))
    return found if as_of_us is None else found.filter(F.lit(as_of_us) - F.col("last_us") <= grace)


def newest_only(batch: DataFrame, by: list[str], order: str) -> DataFrame:
    """For foreachBatch on live sources: of each key the newest row; stale frames are dropped on purpose."""
    from ..operators.progress import newest

    return newest(batch, by, order)


def frames(spark, path: str, schema, limit: int | None = None) -> DataFrame:
    """A finite source: rows of Parquet files as a stream, for trigger(availableNow=True); with limit, frames before it."""
    out = spark.readStream.schema(schema).parquet(path)
    return out if limit is None else out.filter(F.col("frame") < limit)


def polled(alerts: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Alerts for a client that polls: each (frame, track_id) once."""
    return alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["frame", "track_id"])
