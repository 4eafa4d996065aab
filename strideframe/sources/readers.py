"""Readers for sensor text, heart-rate CSV, recognition JSON and frame folders.

Each reader is a scan plus a parser.  The parser is a plain DataFrame function, so the
same rules apply to text that arrives in a table or a stream.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strideframe.functions.text import reps_sets, reps_sum
from strideframe.functions.timex import first_time
from strideframe.operators.keyed import pick_first, prefer
from strideframe.operators.sequence import index_rows

# Header spellings of the sensor channels, best first.
SENSOR_ALIASES: dict[str, tuple[str, ...]] = {
    "time": ("时间", "timestamp", "time", "datetime", "日期时间"),
    "ax": ("加速度x(g)", "加速度x", "accx", "acc_x", "accelerometerx", "ax"),
    "ay": ("加速度y(g)", "加速度y", "accy", "acc_y", "accelerometery", "ay"),
    "az": ("加速度z(g)", "加速度z", "accz", "acc_z", "accelerometerz", "az"),
    "gx": ("角速度x(°/s)", "角速度x", "gyrox", "gyro_x", "gx"),
    "gy": ("角速度y(°/s)", "角速度y", "gyroy", "gyro_y", "gy"),
    "gz": ("角速度z(°/s)", "角速度z", "gyroz", "gyro_z", "gz"),
    "angle_x": ("角度x(°)", "角度x", "anglex", "angle_x", "roll"),
    "angle_y": ("角度y(°)", "角度y", "angley", "angle_y", "yaw", "heading"),
    "angle_z": ("角度z(°)", "角度z", "anglez", "angle_z", "pitch"),
    "height": ("高度(m)", "高度", "height", "altitude"),
    "pressure": ("气压(kpa)", "气压", "pressure", "barometer"),
}
SENSOR_REQUIRED = ("time", "ax", "ay", "az", "angle_z")
EXCLUDED_LABELS = ("热身", "拉伸", "未知动作（无器材 ）")
TRANSITION_LABELS = ("过渡", "transition", "")
REST_LABELS = ("休息", "rest")
OPEN_END = 99_999.0

_CHANNELS = ("ax", "ay", "az", "gx", "gy", "gz", "angle_x", "angle_y", "angle_z")


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines with the recording id: the name of the file's folder."""
    return spark.read.text(paths).select("value", _folder(F.col("_metadata.file_path")).alias("recording_id"))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def documents(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.json") -> DataFrame:
    """Whole small text files (``value``) with their path, found recursively."""
    return (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )


def parse_sensor_lines(rows: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Tab-separated sensor lines to typed rows with ``t_rel`` from the first record.

    A line with fewer than nine fields, an unreadable time or an unreadable (or ``null``)
    acceleration or rotation is dropped; missing angles stay NULL.
    """
    parts = F.split(F.trim("value"), "\t")
    cells = {c: F.nullif(F.get(parts, F.lit(i)), F.lit("null")).try_cast("double") for i, c in enumerate(_CHANNELS, 2)}
    stamp = F.try_to_timestamp(F.regexp_replace(F.get(parts, F.lit(0)), "T", " ")).cast("timestamp")
    typed = rows.filter(F.size(parts) >= 9).select(*keys, stamp.alias("ts"), *[v.alias(k) for k, v in cells.items()]).filter(F.col("ts").isNotNull())
    first = typed.groupBy(*keys).agg(F.min("ts").alias("_t0"))
    timed = typed.join(first, list(keys)).withColumn("t_rel", (F.unix_micros("ts") - F.unix_micros("_t0")) / 1e6).drop("_t0")
    return timed.dropna(subset=list(_CHANNELS[:6]))


def read_imu(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_sensor_lines(lines(spark, paths))


def resolve_columns(header: Sequence[str], aliases: Mapping[str, Sequence[str]] = SENSOR_ALIASES, required: Sequence[str] = SENSOR_REQUIRED) -> dict[str, str]:
    """Channel -> header name: equal spellings first, then contained ones."""

    def plain(s: str) -> str:
        return re.sub(r"[ _-]", "", s.strip().lower()).replace("（", "(").replace("）", ")")

    names = {h: plain(h) for h in header}
    found: dict[str, str] = {}
    for channel, spellings in aliases.items():
        wanted = [plain(s) for s in spellings]
        hits = [h for w in wanted for h, n in names.items() if n == w] or [h for w in wanted for h, n in names.items() if w in n]
        if hits:
            found[channel] = hits[0]
    lost = [c for c in required if c not in found]
    if lost:
        raise ValueError(f"missing sensor columns {lost} in header {list(header)}")
    return found


def read_sensor_flexible(spark: SparkSession, layouts: Sequence[str | Sequence[str]], sep: str = ",", aliases: Mapping[str, Sequence[str]] = SENSOR_ALIASES) -> DataFrame:
    """Sensor files under any known header spelling; each entry of ``layouts`` is a path or
    list of paths that share one header."""
    out = None
    for paths in layouts:
        raw = spark.read.option("header", True).option("sep", sep).csv(paths)
        names = resolve_columns(raw.columns, aliases)
        cols = [F.try_to_timestamp(F.col(f"`{h}`")).alias(c) if c == "time" else F.col(f"`{h}`").try_cast("double").alias(c) for c, h in names.items()]
        part = raw.select(*cols, _folder(F.col("_metadata.file_path")).alias("recording_id"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def hr_columns(header: Sequence[str]) -> tuple[str, str]:
    """The time and heart-rate columns of a header, by keyword."""
    low = [(h, h.lower().strip().lstrip("﻿")) for h in header]
    time = next((h for h, x in low if "time" in x or x == "ts"), None)
    rate = next((h for h, x in low if "bpm" in x or "heart" in x or x == "hr"), None)
    if time is None or rate is None:
        raise ValueError(f"no time or heart-rate column in {list(header)}")
    return time, rate


def parse_hr(rows: DataFrame, time: str, rate: str, base: Column) -> DataFrame:
    """Heart-rate rows: an ISO time, or seconds after ``base``; bad rows are dropped."""
    raw = F.trim(F.col(f"`{time}`"))
    iso = F.try_to_timestamp(F.regexp_replace(raw, "T", " ")).cast("timestamp")
    sec = raw.try_cast("double")
    at = F.when(sec.isNotNull(), F.timestamp_micros((F.unix_micros(base.cast("timestamp")) + sec * 1e6).cast("long"))).otherwise(iso)
    bpm = F.trim(F.col(f"`{rate}`")).try_cast("double").try_cast("int")
    return rows.withColumns({"ts": at, "heart_rate": bpm}).filter(F.col("ts").isNotNull() & F.col("heart_rate").isNotNull())


def read_hr_csv(spark: SparkSession, paths: str | Sequence[str], session_date: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(paths)
    time, rate = hr_columns(raw.columns)
    return parse_hr(raw, time, rate, F.lit(session_date)).select("ts", "heart_rate")


_RESULT = "struct<segmentId:string,seg_idx:int,startTime:double,endTime:double,result:struct<exercise:string,exercise_id:string,equipment:string,confidence:string,sets:string,reps:string,total_sets:string,total_reps:string,phase1_adjustment:struct<expand_before_sec:double,expand_after_sec:double>>>"


def parse_recognition(docs: DataFrame, *keep: str) -> DataFrame:
    """Results of recognition documents, one row each.

    The root is an object with ``results`` or a list.  ``sets`` is a list of sets, or a
    number next to ``reps``, which is then split evenly.  Totals come from the sets when
    absent; an absent segment id is built from ``seg_idx``.
    """
    as_list = F.from_json("value", f"array<{_RESULT}>")
    as_dict = F.from_json("value", f"struct<results:array<{_RESULT}>>")["results"]
    rows = docs.select(*keep, F.explode(F.when(F.trim("value").startswith("["), as_list).otherwise(as_dict)).alias("r"))
    r = F.col("r.result")
    number, total = r["sets"].try_cast("double").try_cast("int"), F.coalesce(r["reps"].try_cast("double").try_cast("int"), F.lit(0))
    listed = F.from_json(r["sets"], "array<struct<set_number:int,reps:int>>")
    each = F.when(number > 0, F.transform(F.sequence(F.lit(1), F.greatest(number, F.lit(1))), lambda i: F.struct(i.alias("set_number"), F.floor(total / number).cast("int").alias("reps"))))
    sets = F.coalesce(F.when(number.isNotNull(), each), listed, F.array().cast("array<struct<set_number:int,reps:int>>"))
    sum_reps = F.aggregate(sets, F.lit(0), lambda a, s: a + F.coalesce(s["reps"], F.lit(0)))
    return rows.select(
        *keep, F.coalesce("r.segmentId", F.concat(F.lit("seg_"), F.col("r.seg_idx").cast("string"))).alias("segment_id"), F.col("r.startTime").alias("start_sec"), F.col("r.endTime").alias("end_sec"),
        r["exercise"].alias("exercise"), r["exercise_id"].alias("exercise_id"), r["equipment"].alias("equipment"), r["confidence"].try_cast("double").alias("confidence"), sets.alias("sets"),
        F.coalesce(r["total_sets"].try_cast("double").try_cast("int"), F.when(number.isNotNull(), number), F.size(sets)).alias("total_sets"),
        F.coalesce(r["total_reps"].try_cast("double").try_cast("int"), F.when(number.isNotNull(), total), sum_reps).alias("total_reps"),
        F.col("r.result.phase1_adjustment").alias("phase1_adjustment"),
    )


def read_recognition(spark: SparkSession, folder: str, name: str = "exercise_result.json") -> DataFrame:
    """``<version>/<recording>/<name>`` below a folder."""
    docs = documents(spark, folder, name).withColumns(
        {"version": F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1), "recording_id": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)}
    )
    return parse_recognition(docs, "version", "recording_id")


def parse_periods(docs: DataFrame, *keep: str) -> DataFrame:
    """Segments of period documents, with times from whichever field is present."""
    kind = "struct<segments:array<struct<segmentId:string,start:string,end:string,start_time:string,end_time:string,start_sec:string,end_sec:string,state:string,equipment:string,posture:string,confidence:double,reason:string>>>"
    rows = docs.select(*keep, F.posexplode(F.from_json("value", kind)["segments"]).alias("i", "s"))
    return rows.select(
        *keep, F.coalesce("s.segmentId", F.concat(F.lit("seg_"), F.col("i").cast("string"))).alias("segment_id"),
        first_time(F.col("s.start_sec"), F.col("s.start"), F.col("s.start_time")).alias("start_sec"), first_time(F.col("s.end_sec"), F.col("s.end"), F.col("s.end_time")).alias("end_sec"),
        "s.state", "s.equipment", "s.posture", "s.confidence", "s.reason",
    )


def read_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Adjusted period documents where a recording has one, else the raw ones."""
    def docs(name: str) -> DataFrame:
        return documents(spark, folder, name).select("value", _folder(F.col("path")).alias("recording_id"))

    return parse_periods(prefer([docs("period_result_adjusted.json"), docs("period_result.json")], ["recording_id"]), "recording_id")


def parse_truth(docs: DataFrame, *keys: str) -> DataFrame:
    """Ground-truth rows of JSON lists: type inferred from the label when absent, an open
    end replaced by the recording's last real end, reps text read as sets and reps."""
    quoted = F.regexp_replace(F.regexp_replace("value", r"\bTOTAL\b", str(int(OPEN_END))), r",\s*\]", "]")
    kind = "array<struct<start:string,end:string,start_offset:double,end_offset:double,type:string,label:string,reps:string>>"
    e = F.col("e")
    low = F.lower(F.coalesce(e["label"], F.lit("")))
    inferred = F.when(low.isin(*TRANSITION_LABELS), "transition").when(low.isin(*REST_LABELS), "rest").otherwise("exercise")
    rows = docs.select(*keys, F.explode(F.from_json(quoted, kind)).alias("e")).select(
        *keys, e["start"].alias("start_text"), e["end"].alias("end_text"), e["start"].try_cast("double").alias("start_sec"), e["end"].try_cast("double").alias("end_sec"), e["start_offset"].alias("start_offset"), e["end_offset"].alias("end_offset"),
        F.coalesce(e["type"], inferred).alias("type"), F.coalesce(e["label"], F.lit("")).alias("label"), F.coalesce(reps_sets(e["reps"]), F.lit(1)).alias("sets"), reps_sum(e["reps"]).alias("reps"),
    )
    last = rows.filter(F.col("end_sec") < OPEN_END).groupBy(*keys).agg(F.max("end_sec").alias("_last"))
    return rows.join(last, list(keys), "left").withColumn("end_sec", F.when(F.col("end_sec") >= OPEN_END, F.coalesce("_last", "end_sec")).otherwise(F.col("end_sec"))).drop("_last")


def exercise_truth(truth: DataFrame) -> DataFrame:
    """Only exercise events with a countable label."""
    return truth.filter((F.col("type") == "exercise") & ~F.col("label").isin(*EXCLUDED_LABELS))


def read_truth(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "ground_truth.json").select("value", _folder(F.col("path")).alias("recording_id"))
    return parse_truth(docs, "recording_id")


def parse_mapping(docs: DataFrame, value_type: str) -> DataFrame:
    """A JSON object keyed by id, as (key, fields) rows."""
    return docs.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("key", "v")).select("key", "v.*")


def read_mapping(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    return parse_mapping(spark.read.option("wholetext", True).text(path), value_type)


def parse_series(docs: DataFrame, item_type: str, *keep: str) -> DataFrame:
    """A cached JSON list (frames, flow records) as rows."""
    return docs.select(*keep, F.inline(F.from_json("value", f"array<{item_type}>")))


FLOW_ITEM = "struct<frame_pair:array<int>,time_sec:double,avg_flow:double,max_flow:double,motion_energy:double,dominant_angle:double,dominant_direction:string>"
FRAME_ITEM = "struct<index:int,timestamp:double,path:string>"


def read_series(spark: SparkSession, folder: str, name: str, item_type: str) -> DataFrame:
    docs = documents(spark, folder, name).select("value", _folder(F.col("path")).alias("recording_id"))
    return parse_series(docs, item_type, "recording_id")


def discover(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files that match a pattern below a folder, and the folder that holds each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime", _folder(F.col("path")).alias("folder"))


_PLAN = "struct<generated_at:string,plan:struct<weekly_schedule:array<struct<day:int,theme:string,exercises:array<struct<phase:string,exercise_id:string,name:string,sets:int,reps_or_duration:string,rest_sec:int,superset_group:string>>>>>>"


def parse_plans(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per planned exercise of weekly plan documents."""
    parsed = docs.select(*keep, F.from_json("value", _PLAN).alias("p"))
    days = parsed.select(*keep, F.col("p.generated_at").alias("generated_at"), F.explode("p.plan.weekly_schedule").alias("d"))
    return days.select(*keep, "generated_at", "d.day", "d.theme", F.posexplode("d.exercises").alias("position", "x")).select(*keep, "generated_at", "day", "theme", "position", "x.*")


def read_plans(spark: SparkSession, folder: str) -> DataFrame:
    """``<version>_<user>.json`` files."""
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    docs = documents(spark, folder).select("value", F.regexp_extract(name, r"^([^_]+)_", 1).alias("version"), F.regexp_extract(name, r"^[^_]+_(.+)$", 1).alias("user_id"))
    return parse_plans(docs, "version", "user_id")


def numbered_frames(names: DataFrame, keys: Sequence[str], path: str, every: int = 1) -> DataFrame:
    """Frames of a folder by the number in their name, first file per number, every k-th kept."""
    index = F.regexp_extract(F.regexp_extract(path, r"([^/]+)$", 1), r"(\d+)", 1).try_cast("long")
    one = pick_first(names.withColumn("index", index).filter(F.col("index").isNotNull()), [*keys, "index"], [path])
    placed = index_rows(one, keys, ["index"], width=50_000)
    return placed.filter(F.pmod(F.col("pos") - 1, F.lit(every)) == 0).drop("pos")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    ranged = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return ranged.options(**options).load()
