"""Stream results equal batch results."""
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from rallygrid import fixtures
from rallygrid.operators.shuttle import shuttle_motion
from rallygrid.operators.timeline import gap_caps
from rallygrid.streaming.live import LateRows, stream_coverage, stream_sessions, stream_shuttle_motion

SF = "/root/testdata/sf0.001"


def _feed(spark, folder):
    rows = fixtures.table(spark, SF, "fx_shuttle").select(
        "clip_id", F.col("frame_index").cast("long").alias("frame_index"), "timestamp_s", "x", "y", "confidence", "source", "low_confidence",
        F.timestamp_micros(((F.col("timestamp_s") + 1e6) * 1000000).cast("long")).alias("ts"))
    # A last row far in the future lets the watermark pass everything before it.
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("clip_id"), F.lit(0).cast("long").alias("frame_index"), F.lit(900.0).alias("timestamp_s"),
                               F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(0.1).alias("confidence"),
                               F.lit("missing").alias("source"), F.lit(True).alias("low_confidence"), F.timestamp_seconds(F.lit(1000900)).alias("ts"))
    # Three files by time, the middle one with its rows in reverse order.
    for k in range(3):
        part = rows.where((F.col("timestamp_s") >= k * 1.2) & ((F.col("timestamp_s") < (k + 1) * 1.2) | F.lit(k == 2)))
        part.coalesce(1).orderBy(F.desc("ts") if k == 1 else "ts").coalesce(1).write.mode("append").parquet(folder)
    end.coalesce(1).write.mode("append").parquet(folder)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_motion_equals_batch_on_all_columns(spark, tmp_path):
    """Cut flags, image bounds and jumps among the columns; the middle file comes in reverse order."""
    extra = lambda df: df.withColumns({"flags": F.when(F.col("frame_index") % 17 == 5, F.array(F.lit("camera_cut"))), "width": F.lit(640), "height": F.lit(360)})
    rows, stream = _feed(spark, str(tmp_path / "in"))
    _run(stream_shuttle_motion(extra(stream), 0.25, delay="3 seconds"), "live_motion")
    batch = shuttle_motion(extra(rows), gap_cap_s=0.25)
    text = lambda df: sorted((str(tuple(r)) for r in df.select(*[F.concat_ws(";", c) if c == "quality_flags" else F.col(c) for c in batch.columns]).collect()))
    live = spark.table("live_motion").where("clip_id >= 0")
    assert text(live) == text(batch)
    flags = {f for r in live.select("quality_flags").distinct().collect() for f in r.quality_flags}
    assert {"observation_gap", "large_image_jump_review", "camera_cut", "shuttle_outside_image", "low_confidence_shuttle"} <= flags


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    rows, stream = _feed(spark, str(tmp_path / "in"))
    behind = rows.where("frame_index % 7 = 2")
    behind.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # read last, when the watermark stands far beyond them
    late = LateRows()
    spark.streams.addListener(late)
    try:
        q = _run(stream_shuttle_motion(stream, 0.25, delay="3 seconds"), "live_late")
        seen = sum(p.numInputRows for p in q.recentProgress)
        for _ in range(100):  # the listener hears of a batch a moment after it ends
            if late.table(spark).agg(F.sum("input_rows")).first()[0] == seen:
                break
            time.sleep(.1)
    finally:
        spark.streams.removeListener(late)
    table = late.table(spark)
    engine = table.agg(F.sum("behind_watermark")).first()[0]
    live = spark.table("live_late").where("clip_id >= 0")
    emitted, dropped = live.where("frame_index is not null").count(), live.agg(F.sum("late_rows")).first()[0]
    assert engine > 100 and dropped > 0 and {r.query for r in table.collect()} == {"live_late"}
    assert emitted == rows.count() and emitted + dropped + engine == rows.count() + behind.count()


def test_repeated_rows_are_counted(spark, tmp_path):
    rows, _ = _feed(spark, str(tmp_path / "in"))
    again = rows.where("frame_index % 10 = 3")
    again.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    _run(stream_shuttle_motion(stream, 0.25, delay="3 seconds"), "live_repeats")
    live = spark.table("live_repeats").where("clip_id >= 0")
    assert live.where("frame_index is not null").count() == rows.count()
    assert live.agg(F.sum("late_rows")).first()[0] == again.count()


def test_state_does_not_grow_with_batches(spark, tmp_path):
    """One clip that goes on and on: what is kept after many batches is what the delay holds."""
    folder, sizes = str(tmp_path / "in"), []
    rows, _ = _feed(spark, str(tmp_path / "one"))
    for k in range(6):
        part = spark.range(20 * k, 20 * k + 20).select(F.lit(5).cast("long").alias("clip_id"), F.col("id").alias("frame_index"), (F.col("id") * .1).alias("timestamp_s"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"),
                                                        F.lit(.9).alias("confidence"), F.lit("detected").alias("source"), F.lit(False).alias("low_confidence"), F.timestamp_millis(F.col("id") * 100).alias("ts"))
        part.coalesce(1).write.mode("append").parquet(folder)
        q = (stream_shuttle_motion(spark.readStream.schema(rows.schema).parquet(folder), 0.25, delay="1 seconds", idle_s=60.0).writeStream.format("noop")
             .option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(120)
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert max(sizes[2:]) <= sizes[1] + 2


def test_idle_clips_are_forgotten(spark, tmp_path):
    folder, sizes = str(tmp_path / "in"), []
    rows, stream = _feed(spark, folder)
    for k in range(3):
        later = rows.limit(1).withColumns({"clip_id": F.lit(-2).cast("long"), "frame_index": F.lit(k).cast("long"), "ts": F.timestamp_seconds(F.lit(1002000 + 100 * k))})
        later.coalesce(1).write.mode("append").parquet(folder)
        q = (stream_shuttle_motion(stream, 0.25, delay="3 seconds", idle_s=1.0).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log"))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(120)
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert sizes[-1] <= 8  # one clip's row, tally and timers


def test_stream_coverage_counts_every_row(spark, tmp_path):
    rows, stream = _feed(spark, str(tmp_path / "in"))
    _run(stream_coverage(stream), "live_coverage")
    live = spark.table("live_coverage").where("clip_id >= 0").agg(F.sum("frames"), F.sum("missing"), F.sum("weak")).first()
    assert tuple(live) == (rows.count(), rows.where("source = 'missing'").count(), rows.where("low_confidence").count())


def test_stream_sessions_split_at_each_clips_own_cap(spark, tmp_path):
    """Clips of different cadence: the stretches are those of the batch, where a step longer than the clip's cap begins a new one."""
    rows, stream = _feed(spark, str(tmp_path / "in"))
    caps = gap_caps(rows)
    assert caps.select("gap_cap_s").distinct().count() > 1
    caps.write.parquet(str(tmp_path / "caps"))
    _run(stream_sessions(stream, spark.read.parquet(str(tmp_path / "caps"))), "live_sessions")
    live = {tuple(r) for r in spark.table("live_sessions").where("clip_id >= 0").select("clip_id", "start", "end", "frames", "detected", "missing", "weak").collect()}
    w = Window.partitionBy("clip_id").orderBy("ts")
    step = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    cut = rows.join(caps, "clip_id").withColumn("new", (step > F.round(F.col("gap_cap_s") * 1000000)).cast("int")).withColumn("k", F.sum(F.coalesce("new", F.lit(0))).over(w))
    batch = {tuple(r)[:1] + tuple(r)[2:] for r in cut.groupBy("clip_id", "k").agg(F.min("ts"), F.max("ts"), F.count("*"), F.count_if(F.col("source") == "detected"), F.count_if(F.col("source") == "missing"), F.count_if("low_confidence")).collect()}
    assert live == batch and len(batch) > 30
