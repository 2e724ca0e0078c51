"""Measures on live detector output, with Structured Streaming.

Stateful motion needs the RocksDB state store (``STATE_STORE``), which keeps keyed state and timers off the heap.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from ..functions.flags import flag_set, merge
from ..operators.shuttle import shuttle_observations
from ..operators.timeline import CLIP
from ..policy import POLICY, Policy

#: Setting that a session with live motion needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

ROW = ["frame_index", "timestamp_s", "x_px", "y_px", "source", "valid_observation", "diagonal_px", "flags", "at_ms"]
_TYPES = ["bigint", "double", "double", "double", "string", "boolean", "double", "string", "bigint"]
_HELD = ", ".join(f"{n} {t}" for n, t in zip(ROW[1:], _TYPES[1:]))
_LINK = {"interval_start_frame": "bigint", "interval_duration_s": "double", "displacement_px": "double", "observation_gap": "boolean", "late_rows": "bigint"}
LINKED = f"{CLIP} bigint, " + ", ".join(f"{n} {t}" for n, t in zip(ROW, _TYPES)) + ", " + ", ".join(f"{n} {t}" for n, t in _LINK.items())


def _plain(row) -> tuple:
    """Plain Python values of one row, as the state store needs them."""
    return tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in row)


class ShuttleLinks(StatefulProcessor):
    """One clip: each row is held under its frame until the watermark has passed it, then linked to the row before.

    A held row has its own entry and timer, so a batch writes what it brings and what it lets go and nothing else.
    A clip that holds nothing and stays silent for ``idle_ms`` of event time is forgotten.
    """

    def __init__(self, gap_cap_s: float, idle_ms: int):
        self.gap_cap_s, self.idle_ms = gap_cap_s, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "frame_index bigint, " + _HELD)
        self.held = handle.getMapState("held", "frame_index bigint", _HELD)
        self.forget = handle.getValueState("forget", "at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late, last, before = 0, self.last.get(), self.forget.get()
        seen = max(0, timerValues.getCurrentWatermarkInMs())
        for batch in rows:
            for row in batch[ROW].itertuples(index=False):
                row = _plain(row)
                if (last is not None and row[0] <= last[0]) or self.held.containsKey((row[0],)):
                    late += 1
                else:
                    self.held.updateValue((row[0],), row[1:])
                    self.handle.registerTimer(max(row[-1], seen) + 1)
                seen = max(seen, row[-1])
        if before is not None:
            self.handle.deleteTimer(before[0])
        self.forget.update((seen + self.idle_ms + 2,))
        self.handle.registerTimer(seen + self.idle_ms + 2)
        if late:
            yield self.table([(key[0], *[None] * len(ROW), None, None, None, None, late)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, forget = timerValues.getCurrentWatermarkInMs(), self.forget.get()
        rows = sorted((k[0], *v) for k, v in self.held.iterator())
        ripe = [r[0] for r in rows if r[-1] <= mark]
        if ripe:
            # Rows behind a ripe one are ripe too, or order would be lost.
            out = [r for r in rows if r[0] <= max(ripe)]
            for r in out:
                self.held.removeKey((r[0],))
            yield self.linked(key[0], out)
            self.last.update(out[-1])
            rows = rows[len(out):]
        if not rows and forget is not None and forget[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            self.forget.clear()

    def linked(self, clip: int, rows: list[tuple]) -> pd.DataFrame:
        out, before = [], self.last.get()
        for row in rows:
            frame, at, x, y, _, valid = row[:6]
            both = before is not None and bool(valid and before[5])
            dt = at - before[1] if both else None
            joined = both and frame == before[0] + 1 and dt <= self.gap_cap_s
            moved = ((x - before[2]) * (x - before[2]) + (y - before[3]) * (y - before[3])) ** 0.5 if joined else None
            out.append((clip, *row, before[0] if joined else None, dt if joined else None, moved, both and not joined, 0))
            before = row
        return self.table(out)

    @staticmethod
    def table(rows: list[tuple]) -> pd.DataFrame:
        whole = {"frame_index": "Int64", "at_ms": "Int64", "interval_start_frame": "Int64", "valid_observation": "boolean", "observation_gap": "boolean"}
        return pd.DataFrame(rows, columns=[CLIP, *ROW, *_LINK]).astype(whole)

    def close(self) -> None:
        pass


def stream_shuttle_motion(stream: DataFrame, gap_cap_s: float = POLICY.min_gap_cap_s, event_time: str = "ts",
                          delay: str = "2 seconds", policy: Policy = POLICY, idle_s: float = 3600.0) -> DataFrame:
    """Live form of the batch shuttle motion, with all its columns, the row before kept as state per clip.

    The gap cap is given, as a running median does not exist.  Rows out of order
    within ``delay`` are put in order.  Rows behind what was already emitted, and
    repeats of a frame, are dropped: for each batch and clip that has some comes a row without a frame whose ``late_rows``
    counts them (0 on all others).  Rows that are behind the watermark are dropped by the engine before they come here, and ``LateRows`` counts those.  State goes ``idle_s``
    after a clip's last row, so it grows with the clips that are live, not with all there ever were.
    """
    known = {"width", "height"} <= set(stream.columns)
    diagonal = F.sqrt(F.col("width").cast("double") * F.col("width") + F.col("height").cast("double") * F.col("height")) if known else F.lit(None).cast("double")
    rows = (shuttle_observations(stream, policy).withWatermark(event_time, delay)
            .select(CLIP, event_time, F.col("frame_index").cast("long").alias("frame_index"), F.col("timestamp_s").cast("double").alias("timestamp_s"), "x_px", "y_px", "source",
                    "valid_observation", diagonal.alias("diagonal_px"), F.concat_ws(";", "quality_flags").alias("flags"), F.unix_millis(event_time).alias("at_ms")))
    linked = rows.groupBy(CLIP).transformWithStateInPandas(ShuttleLinks(gap_cap_s, int(idle_s * 1000)), LINKED, "Append", "EventTime")
    jump = F.coalesce((F.col("diagonal_px") > 0) & (F.col("displacement_px") / F.col("diagonal_px") >= policy.jump_fraction_of_diagonal), F.lit(False))
    own = F.filter(F.split("flags", ";"), lambda f: f != "")
    return linked.select(
        CLIP, "frame_index", "timestamp_s", "x_px", "y_px", "source", "valid_observation", "interval_start_frame", "interval_duration_s", "displacement_px",
        F.try_divide("displacement_px", "interval_duration_s").alias("image_speed_px_s"), F.lit(None).cast("double").alias("physical_speed_km_h"),
        merge(own, flag_set((jump, "large_image_jump_review"), (F.col("observation_gap"), "observation_gap"))).alias("quality_flags"), "late_rows")


class LateRows(StreamingQueryListener):
    """Counts, batch by batch, the rows that a query dropped because they were behind its watermark.

    Add it to the session's ``streams``; ``table`` gives one row per batch: a handful of numbers on the driver.
    """

    FIELDS = "query string, batch bigint, input_rows bigint, behind_watermark bigint"

    def __init__(self):
        self.batches: dict[tuple[str, int], tuple[str, int, int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        # A batch that runs again after a failure takes the place of its first attempt.
        self.batches[str(p.id), p.batchId] = (p.name or str(p.id), p.batchId, p.numInputRows, dropped)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.batches.values()), self.FIELDS)


def _counts() -> list:
    return [F.count(F.lit(1)).alias("frames"), F.count_if(F.col("source") == "detected").alias("detected"),
            F.count_if(F.col("source") == "missing").alias("missing"), F.count_if("low_confidence").alias("weak")]


def stream_coverage(stream: DataFrame, event_time: str = "ts", window: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Detected, missing and weak frames per clip and tumbling window."""
    return (stream.withWatermark(event_time, delay).groupBy(CLIP, F.window(event_time, window).alias("w")).agg(*_counts())
                  .select(CLIP, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "detected", "missing", "weak"))


def stream_sessions(stream: DataFrame, caps: DataFrame | None = None, event_time: str = "ts", delay: str = "10 seconds", policy: Policy = POLICY) -> DataFrame:
    """The same counts per unbroken stretch of frames.

    A stretch ends where a step exceeds the clip's gap cap: ``caps`` (``clip_id, gap_cap_s``, a stored table) is joined to the stream, and clips that
    it lacks have the least cap there is.
    """
    least = F.lit(policy.min_gap_cap_s)
    rows = stream.withColumn("cap", least) if caps is None else (
        stream.join(caps.select(CLIP, F.col("gap_cap_s").alias("cap")), CLIP, "left").withColumn("cap", F.coalesce("cap", least)))
    # Sessions end before start + gap; a step of exactly the cap still belongs to the stretch.
    gap = F.concat(F.round(F.col("cap") * 1000000 + 1).cast("long").cast("string"), F.lit(" microseconds"))
    return (rows.withColumn("gap", gap).withWatermark(event_time, delay).groupBy(CLIP, F.session_window(event_time, F.col("gap")).alias("w")).agg(*_counts(), F.max(event_time).alias("last"))
                .select(CLIP, F.col("w.start").alias("start"), F.col("last").alias("end"), "frames", "detected", "missing", "weak"))
