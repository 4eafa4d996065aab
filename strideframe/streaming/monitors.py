"""Streaming operators and their batch twins.

Windows here are aligned to the epoch (streams cannot anchor per recording); the batch
window operators are anchored at each recording's start.  Event time is ``ts``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strideframe.functions.ladders import ACC_STD, AZ_POSTURE, ladder
from strideframe.operators.load import BodyDefaults, met_kcal
from strideframe.operators.sequence import index_rows
from strideframe.session import checkpointed

LOW_MOTION = 0.2
IDLE_SECONDS = 180.0
QUEUE_LIMIT = 2


def recovery_status(hrv: Column, fatigue: Column) -> tuple[Column, Column]:
    """Status and load adjustment; works on streams and tables alike."""
    low, medium = (fatigue > 7) | (hrv < 35), (fatigue > 5) | (hrv < 50)
    return (
        F.when(low, "low_recovery").when(medium, "moderate_recovery").otherwise("ready"),
        F.when(low, "-30%").when(medium, "-10%").otherwise("0%"),
    )


def idle_alerts(df: DataFrame, keys: Sequence[str], at: str, tie: str, motion: str, threshold: float = LOW_MOTION, seconds: float = IDLE_SECONDS) -> DataFrame:
    """Batch twin of :func:`idle_alert_stream`: the first reading of each low-motion run that
    comes more than ``seconds`` after its start."""
    rows = index_rows(df.select(*keys, at, tie, (F.col(motion) < threshold).cast("int").alias("_low")), keys, [at, tie], label="_low")
    starts = rows.filter("_low = 1").groupBy(*keys, "run_id").agg(F.min(at).alias("since"))
    late = rows.filter("_low = 1").join(starts, [*keys, "run_id"]).filter(F.col(at) - F.col("since") > seconds)
    return late.groupBy(*keys, "run_id").agg(F.any_value("since").alias("since"), F.min(at).alias("alert_at")).drop("run_id")


_STATE = T.StructType([T.StructField("since", T.DoubleType()), T.StructField("alerted", T.BooleanType()), T.StructField("seen", T.DoubleType())])


def idle_alert_stream(stream: DataFrame, key: str, motion: str, threshold: float = LOW_MOTION, seconds: float = IDLE_SECONDS, delay: str = "1 minute", forget_sec: float = 3600.0) -> DataFrame:
    """One alert per user and low-motion run, with a three-value state per user.

    A silent user's state is dropped ``forget_sec`` of event time after the last reading.
    A task holds one user's readings of one micro-batch; bound it at the source (files or
    offsets per trigger).
    """

    def follow(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, alerted, seen = state.get if state.exists else (None, False, None)
        out = []
        rows = pd.concat(batches).sort_values("at")
        for at, value in zip(rows["at"], rows["motion"]):
            if value >= threshold:
                since, alerted = None, False
            elif since is None:
                since, alerted = at, False
            elif not alerted and at - since > seconds:
                alerted = True
                out.append((group[0], since, at))
            seen = at
        state.update((since, alerted, seen))
        state.setTimeoutTimestamp(max(int((seen + forget_sec) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "since", "alert_at"])

    timed = stream.withWatermark("ts", delay).select(F.col(key).alias("user_id"), "ts", (F.unix_micros("ts") / 1e6).alias("at"), F.col(motion).cast("double").alias("motion"))
    out = T.StructType([T.StructField("user_id", stream.schema[key].dataType), T.StructField("since", T.DoubleType()), T.StructField("alert_at", T.DoubleType())])
    return timed.groupBy("user_id").applyInPandasWithState(follow, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def equipment_latest(df: DataFrame) -> DataFrame:
    """Last known state per equipment (update mode on a stream), free and crowded flags."""
    last = df.groupBy("equipment_id").agg(F.max_by(F.struct("occupied", "queue_count"), F.struct("ts", "queue_count")).alias("s"), F.max("ts").alias("ts"))
    return last.select("equipment_id", "ts", "s.occupied", "s.queue_count", (~F.col("s.occupied")).alias("available"), (F.col("s.queue_count") > QUEUE_LIMIT).alias("congested"))


def wait_or_switch(states: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Switch to the first alternative of a crowded machine, else wait.
    ``alternatives`` has (equipment_id, alternative, priority)."""
    first = alternatives.groupBy("equipment_id").agg(F.min_by("alternative", F.struct("priority", "alternative")).alias("_alt"))
    switch = (F.col("queue_count") > QUEUE_LIMIT) & F.col("_alt").isNotNull()
    return states.join(first, "equipment_id", "left").select(
        "equipment_id", (~switch).alias("should_wait"), F.when(switch, F.col("_alt")).alias("suggested")
    )


def tumbling_monitor(df: DataFrame, key: str, size: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Intensity and posture per user and epoch-aligned window (needs ``acc``, ``gyro``, ``az``).

    ``az`` is summed in time order: a mean on a posture's threshold depends on the order.  Its state is a window's readings, which the sensor's rate bounds.
    """
    rows = df.withWatermark("ts", delay) if df.isStreaming else df
    in_order = F.array_sort(F.collect_list(F.when(F.col("az").isNotNull(), F.struct("ts", "az"))))
    az_mean = F.aggregate(in_order, F.lit(0.0), lambda total, r: total + r["az"]) / F.nullif(F.size(in_order), F.lit(0))
    out = rows.groupBy(key, F.window("ts", size)).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("acc").alias("acc_std"), az_mean.alias("az_mean"), F.avg("gyro").alias("gyro_mean"), F.max("gyro").alias("gyro_max")
    )
    return out.select(key, F.col("window.start").alias("start"), "n", "acc_std", "gyro_mean", "gyro_max", ladder(F.col("az_mean"), AZ_POSTURE).alias("posture"), ladder(F.col("acc_std"), ACC_STD).alias("intensity"))


def rest_monitor(df: DataFrame, key: str, size: str = "3 seconds", stride: str = "1 second", threshold: float = 0.05, min_rest: float = 10.0, delay: str = "10 seconds", min_rows: int = 3) -> DataFrame:
    """Rest stretches: sliding still windows joined by a session window of one stride."""
    rows = df.withWatermark("ts", delay) if df.isStreaming else df
    wins = rows.groupBy(key, F.window("ts", size, stride)).agg(F.stddev_pop("acc").alias("s"), F.count(F.lit(1)).alias("n"))
    still = wins.filter((F.col("n") >= min_rows) & (F.col("s") < threshold)).select(key, "window", F.window_time("window").alias("wt"))
    spans = still.groupBy(key, F.session_window("wt", stride)).agg(F.min("window.start").alias("rest_start"), F.max("window.end").alias("rest_end"))
    long = (F.unix_micros(F.col("rest_end").cast("timestamp")) - F.unix_micros(F.col("rest_start").cast("timestamp"))) / 1e6 >= min_rest
    return spans.filter(long).select(key, "rest_start", "rest_end")


def activity_sessions(df: DataFrame, key: str, gap: str = "120 seconds", delay: str = "5 minutes") -> DataFrame:
    """Sessions of readings at most ``gap`` apart."""
    rows = df.withWatermark("ts", delay) if df.isStreaming else df
    return rows.groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def live_calories(stream: DataFrame, catalogue: DataFrame, people: DataFrame, body: BodyDefaults = BodyDefaults()) -> DataFrame:
    """Running energy per session from a stream of executions (update mode)."""
    rows = stream.join(catalogue.select("exercise_id", "met"), "exercise_id", "left").join(people, "session_id")
    kcal = met_kcal(F.col("met"), F.col("duration_sec"), F.col("weight"), F.col("gender"), F.col("age"), body)
    return rows.groupBy("session_id").agg(F.sum(kcal).alias("kcal"), F.count(F.lit(1)).alias("executions"))


def late_split(batch: DataFrame, watermark: float | None) -> tuple[DataFrame, DataFrame]:
    """Rows of a micro-batch on time, and rows before the previous batch's watermark."""
    if watermark is None:
        return batch, batch.filter(F.lit(False))
    late = F.unix_micros(F.col("ts").cast("timestamp")) < int(watermark * 1e6)
    return batch.filter(~late), batch.filter(late)


def _mark_before(rows: DataFrame, folder: str, batch_id: int) -> float | None:
    """The largest watermark written by an earlier batch."""
    try:
        marks = rows.sparkSession.read.schema("mark double, batch_id long").json(folder)
    except AnalysisException:
        return None
    return marks.filter(F.col("batch_id") < batch_id).agg(F.max("mark")).first()[0]


def append_biometrics(path: str, quarantine: str, delay_sec: float, replace: Callable[[DataFrame, str], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows on time go to ``replace`` (user-day replacement), late
    ones to a quarantine folder.

    Late rows and the watermark are written under the batch number, and a batch only reads
    marks of earlier ones, so a batch that runs again after a failure does the same again.
    """
    marks = f"{quarantine}/_marks"

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = checkpointed(batch.dropDuplicates(["user_id", "ts"]))
        mark = _mark_before(rows, f"{marks}/*", batch_id)
        fine, late = late_split(rows, mark)
        if not fine.isEmpty():
            replace(fine, path)
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        top = F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6 - delay_sec
        mark_row = rows.agg(F.greatest(top, F.lit(mark)).alias("mark")).withColumn("batch_id", F.lit(batch_id).cast("long"))
        mark_row.write.mode("overwrite").json(f"{marks}/b{batch_id}")

    return handle


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a new subfolder of a shared folder, and read it back."""
    run = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run}/out")
