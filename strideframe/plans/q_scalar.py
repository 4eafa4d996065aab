"""Scalar text, time, math, array and JSON functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import mathx, text, timex
from strideframe.functions.mathx import fix
from strideframe.functions.sqlfuncs import register_sql
from strideframe.operators.names import numbered
from strideframe.plans import bindings as b
from strideframe.plans.bindings import fx, sql
from strideframe.plans.registry import query


@query("h_s01_normalize_header", "SELECT p_partkey, translate(translate(lower(trim(' ' || p_brand || '_（' || p_name || '）-')), ' _-', ''), '（）', '()') AS header FROM part")
def hs01(t):
    raw = F.concat(F.lit(" "), "p_brand", F.lit("_（"), "p_name", F.lit("）-"))
    return t.part.select("p_partkey", text.normalize_header(raw).alias("header"))


@query("h_s02_drop_brackets", "SELECT p_partkey, p_name AS bare FROM part")
def hs02(t):
    return t.part.select("p_partkey", text.drop_brackets(F.concat("p_name", F.lit("（"), "p_brand", F.lit("）"))).alias("bare"))


@query("h_s03_strip_dirty", "SELECT doc_id, length(regexp_replace(text, '[?\\n\\r\\t\\x00-\\x1f]', '', 'g'))::INT AS n, contains(regexp_replace(text, '[?\\n\\r\\t\\x00-\\x1f]', '', 'g'), '?') AS dirty FROM documents")
def hs03(t):
    clean = F.regexp_replace("text", text.DIRTY_ID, "")
    return t.documents.select("doc_id", F.length(clean).alias("n"), clean.contains("?").alias("dirty"))


@query("h_s04_unique_slug", "SELECT p_partkey, slug || '_' || printf('%03d', row_number() OVER (PARTITION BY slug ORDER BY p_partkey)) AS slug_id FROM (SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60) AS slug FROM part)")
def hs04(t):
    rows = t.part.select("p_partkey", text.slug(F.concat("p_name", F.lit(" #"), "p_brand")).alias("slug"))
    return numbered(rows, "slug", ["p_partkey"], "slug_id").select("p_partkey", "slug_id")


_TAGS = [("ring", "R"), ("red", "C"), ("blue", "C"), ("gear", "G"), ("small", "S")]


@query("h_s05_keyword_tags", "SELECT p_partkey, concat_ws(',', CASE WHEN contains(n, 'ring') THEN 'R' END, CASE WHEN contains(n, 'red') OR contains(n, 'blue') THEN 'C' END, CASE WHEN contains(n, 'gear') THEN 'G' END, CASE WHEN contains(n, 'small') THEN 'S' END) AS tags FROM (SELECT p_partkey, lower(p_name) AS n FROM part)")
def hs05(t):
    return t.part.select("p_partkey", F.array_join(text.keyword_tags(F.col("p_name"), _TAGS), ",").alias("tags"))


@query("h_s06_strip_side_prefix", sql("SELECT exercise_id, regexp_replace(side || primary_muscle, '^b-', '') AS muscle FROM exercises", "exercises"))
def hs06(t):
    return b.exercises(t).select("exercise_id", text.strip_back_prefix(F.concat("side", "primary_muscle")).alias("muscle"))


@query("h_s07_record_text", sql("SELECT exercise_id, concat_ws(' ', name, '主要肌群:', primary_muscle, '器械:', equipment, '难度:', difficulty) AS record FROM exercises", "exercises"))
def hs07(t):
    return b.exercises(t).select("exercise_id", F.concat_ws(" ", "name", F.lit("主要肌群:"), "primary_muscle", F.lit("器械:"), "equipment", F.lit("难度:"), "difficulty").alias("record"))


@query("h_s08_edit_distance", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INT) AS d, CAST(CASE WHEN levenshtein(p_name, 'red bolt') <= 4 THEN levenshtein(p_name, 'red bolt') ELSE -1 END AS INT) AS near FROM part")
def hs08(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").alias("d"), F.levenshtein("p_name", F.lit("red bolt"), 4).alias("near"))


@query("h_s09_split_plural_names", "SELECT p_partkey, trim(unnest(string_split(p_name || ' / ' || p_type, '/'))) AS part_name FROM part")
def hs09(t):
    return t.part.select("p_partkey", F.explode(F.split(F.concat("p_name", F.lit(" / "), "p_type"), "/")).alias("w")).select("p_partkey", F.trim("w").alias("part_name"))


@query("h_d01_date_arithmetic", sql("SELECT session_id, day + 7 AS plus7, date_diff('day', DATE '1995-01-01', day) AS since FROM sessions", "sessions"))
def hd01(t):
    return b.sessions(t).select("session_id", F.date_add("day", 7).alias("plus7"), F.datediff("day", F.lit("1995-01-01").cast("date")).cast("long").alias("since"))


@query("h_d02_sunday_week", sql("SELECT session_id, day - CAST(dayofweek(day) AS INT) AS week_start FROM sessions", "sessions"))
def hd02(t):
    return b.sessions(t).select("session_id", timex.week_start(F.col("day")).alias("week_start"))


@query("h_d03_minutes_between", "SELECT event_id, CAST(floor(CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS DOUBLE) / 60e6 + 0.5::DOUBLE) AS BIGINT) AS minutes FROM events")
def hd03(t):
    return t.events.select("event_id", timex.minutes_between(F.date_trunc("day", "ts"), F.col("ts")).alias("minutes"))


@query("h_d04_month_bounds", sql("SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS first, last_day(day) AS last FROM sessions", "sessions"))
def hd04(t):
    first, last = timex.month_bounds(F.col("day"))
    return b.sessions(t).select(first.alias("first"), last.alias("last")).distinct()


@query("h_d05_clock_seconds", "SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS sec, CAST(minute(ts) * 60 + second(ts) AS DOUBLE) AS short, strftime(ts, '%H:%M:%S') AS clock FROM events")
def hd05(t):
    hms, ms = F.date_format("ts", "HH:mm:ss"), F.date_format("ts", "mm:ss")
    sec = timex.clock_to_sec(hms)
    return t.events.select("event_id", sec.alias("sec"), timex.clock_to_sec(ms).alias("short"), timex.sec_to_clock(sec).alias("clock"))


@query("h_d06_first_time_field", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) ELSE 0 END AS sec FROM events")
def hd06(t):
    m = F.col("event_id") % 3
    return t.events.select("event_id", timex.first_time(F.when(m == 0, F.col("value").cast("string")), F.when(m == 1, F.date_format("ts", "HH:mm:ss"))).alias("sec"))


@query("h_d07_weekday_label", sql("SELECT session_id, ['周日', '周一', '周二', '周三', '周四', '周五', '周六'][dayofweek(day) + 1] AS label FROM sessions", "sessions"))
def hd07(t):
    return b.sessions(t).select("session_id", timex.weekday_label(F.col("day")).alias("label"))


@query("h_m01_magnitude", sql("SELECT row_id, sqrt(ax * ax + ay * ay + az * az) AS acc, sqrt(gx * gx + gy * gy) AS gyro FROM samples", "samples"))
def hm01(t):
    c = F.col
    return b.samples(t).select("row_id", mathx.magnitude(c("ax"), c("ay"), c("az")).alias("acc"), mathx.magnitude(c("gx"), c("gy")).alias("gyro"))


@query("h_m02_circular_distance", sql(f"SELECT row_id, {fx('abs(((angle_z - 180 + 180) % 360 + 360) % 360 - 180)')} AS dist, {fx('((angle_z - angle_x + 180) % 360 + 360) % 360 - 180')} AS delta FROM samples", "samples"))
def hm02(t):
    z = F.col("angle_z")
    return b.samples(t).select("row_id", fix(mathx.circular_distance(z)).alias("dist"), fix(mathx.circular_delta(z, F.col("angle_x"))).alias("delta"))


@query("h_m03_clip_and_ratio", sql(f"SELECT row_id, greatest(10.0::DOUBLE, least(100.0::DOUBLE, value)) AS clipped, {fx('CASE WHEN k = 0 THEN 0 ELSE (value - k) / k * 100 END')} AS trend FROM samples", "samples"))
def hm03(t):
    return b.samples(t).select("row_id", mathx.clip(F.col("value"), 10, 100).alias("clipped"), fix(mathx.trend_pct(F.col("value"), F.col("k"))).alias("trend"))


@query("h_m04_zscore", sql(f"SELECT row_id, {fx('CASE WHEN sd < 1e-8 THEN 0 ELSE (value - m) / sd END', 5)} AS z FROM samples JOIN (SELECT recording_id, avg(value) AS m, stddev_pop(value) AS sd FROM samples GROUP BY ALL) USING (recording_id)", "samples"))
def hm04(t):
    s = b.samples(t).select("recording_id", "row_id", "value")
    m = s.groupBy("recording_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    z = F.when(F.col("sd") < 1e-8, 0.0).otherwise((F.col("value") - F.col("m")) / F.col("sd"))
    return s.join(m, "recording_id").select("row_id", fix(z, 5).alias("z"))


@query("h_m05_box_geometry", sql(f"""SELECT row_id, cx, area, {fx('CASE WHEN area + barea - common > 0 THEN common / (area + barea - common) ELSE 0 END')} AS iou, {fx('sqrt((cx - 60) * (cx - 60) + (cy - 60) * (cy - 60))')} AS dist, CASE WHEN area > 0 THEN common / area >= 0.6 ELSE false END AS inside FROM (
      SELECT row_id, (k + k + 30) / 2 AS cx, (v + v + 20) / 2 AS cy, 600.0::DOUBLE AS area, 1600.0::DOUBLE AS barea, CAST(greatest(0, least(k + 30, 80) - greatest(k, 40)) * greatest(0, least(v + 20, 80) - greatest(v, 40)) AS DOUBLE) AS common FROM (SELECT row_id, k, CAST(floor(value) AS INT) AS v FROM samples))""", "samples"))
def hm05(t):
    v = F.floor("value").cast("int")
    rows = b.samples(t).select("row_id", F.array("k", v, F.col("k") + 30, v + 20).alias("a"), F.array(*[F.lit(x) for x in (40, 40, 80, 80)]).alias("o"))
    a, o = F.col("a"), F.col("o")
    return rows.select("row_id", mathx.box_center(a)[0].alias("cx"), mathx.box_area(a).alias("area"), fix(mathx.box_iou(a, o)).alias("iou"), fix(mathx.box_distance(a, o)).alias("dist"), mathx.box_inside(a, o).alias("inside"))


@query("h_m06_vector_math", f"SELECT vec_id, {fx('sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))', 5)} AS norm, {fx('list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))', 5)} AS dot FROM embeddings")
def hm06(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", fix(mathx.norm(e), 5).alias("norm"), fix(mathx.dot(e, F.reverse(e)), 5).alias("dot"))


@query("h_m07_axis_vectors", sql("SELECT row_id, CASE k % 3 WHEN 0 THEN s * 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x, CASE k % 3 WHEN 1 THEN s * 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM (SELECT row_id, k, CASE WHEN value > 50 THEN 1 ELSE -1 END AS s FROM samples)", "samples"))
def hm07(t):
    name = F.concat(F.when(F.col("value") > 50, "+").otherwise("-"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("k") % 3 + 1))
    v = mathx.unit_axis(name)
    return b.samples(t).select("row_id", v[0].alias("x"), v[1].alias("y"))


@query("h_a01_array_functions", "SELECT user_id, len(list_distinct(list(event_type))) AS kinds, list_contains(list(event_type), 'error') AS has_error FROM events GROUP BY ALL")
def ha01(t):
    g = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    return g.select("user_id", F.size(F.array_distinct("a")).cast("long").alias("kinds"), F.array_contains("a", "error").alias("has_error"))


_VALID = ["red", "blue", "gear", "ring", "small"]


@query("h_a02_split_joined_ids", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: list_contains(['red', 'blue', 'gear', 'ring', 'small'], x)), ',') AS x, CASE WHEN list_contains(['red', 'blue', 'gear', 'ring', 'small'], split_part(p_name, ' ', 1)) THEN 1 ELSE 0 END AS first_ok FROM part")
def ha02(t):
    valid = F.array(*[F.lit(v) for v in _VALID])
    ids = text.split_ids(F.array(F.translate("p_name", " ", "_")), valid)
    first = F.get(F.split("p_name", " "), F.lit(0))
    return t.part.select("p_partkey", F.array_join(ids, ",").alias("x"), F.array_contains(valid, first).cast("int").alias("first_ok"))


@query("h_a03_keep_members", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: list_contains(['red', 'blue', 'gear', 'ring', 'small'], x)), ',') AS kept FROM part")
def ha03(t):
    return t.part.select("p_partkey", F.array_join(text.keep_members(F.split("p_name", " "), F.array(*[F.lit(v) for v in _VALID])), ",").alias("kept"))


@query("h_a04_reps_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 2 END AS sets, CAST(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + 12 END AS BIGINT) AS reps FROM part")
def ha04(t):
    raw = F.when(F.col("p_size") % 3 == 0, "max effort").otherwise(F.concat(F.lit(" 12 x "), F.col("p_size").cast("string"), F.lit("  ")))
    return t.part.select("p_partkey", text.reps_sets(raw).alias("sets"), text.reps_sum(raw).alias("reps"))


@query("h_a05_even_split", "SELECT p_partkey, unnest(range(1, p_size % 4 + 2)) AS set_no, p_size * 3 // (p_size % 4 + 1) AS reps FROM part")
def ha05(t):
    n = F.col("p_size") % 4 + 1
    sets = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("long").alias("set_no"), F.floor(F.col("p_size") * 3 / n).cast("int").alias("reps")))
    return t.part.select("p_partkey", F.inline(sets))


@query("h_j01_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def hj01(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("h_j02_json_emit", "SELECT p_partkey, '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}' AS js FROM part")
def hj02(t):
    return t.part.select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("js"))


@query("h_j03_fenced_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def hj03(t):
    m = F.col("event_id") % 3
    answer = F.when(m == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(m == 1, F.concat(F.lit("Result: "), "props", F.lit(" done."))).otherwise(F.col("props"))
    return t.events.select("event_id", F.from_json(text.fenced_json(answer), "k int")["k"].alias("k"))


@query("h_p01_map_roundtrip", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def hp01(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("event_type", "n"))


@query("q02_sql_functions", sql(f"SELECT row_id, {fx('abs(((angle_z - 180 + 180) % 360 + 360) % 360 - 180)')} AS dist, CASE WHEN gyro > 30 THEN '高强度运动' WHEN gyro > 10 THEN '中等运动' WHEN gyro > 3 THEN '轻微运动' ELSE '静止/休息' END AS label FROM samples", "samples"))
def q02(t):
    register_sql(t.spark)
    return b.samples(t).selectExpr("row_id", "circular_distance(angle_z, 180D) AS d", "gyro_label(gyro) AS label").select("row_id", fix(F.col("d")).alias("dist"), "label")


@query("q05_window_table_function", sql(f"SELECT recording_id, k, k * 400000.0::DOUBLE AS start_sec, least(k * 400000.0::DOUBLE + 500000.0::DOUBLE, total) AS end_sec FROM (SELECT recording_id, max(t_rel) AS total FROM samples GROUP BY ALL), (SELECT range AS k FROM range(100)) WHERE k * 400000 < total AND (k = 0 OR (k - 1) * 400000 + 500000 < total)", "samples"))
def q05(t):
    register_sql(t.spark)
    b.samples(t).groupBy("recording_id").agg(F.max("t_rel").alias("total")).createOrReplaceTempView("recording_totals")
    return t.spark.sql("SELECT r.recording_id, w.k, w.start_sec, w.end_sec FROM recording_totals r, LATERAL windows(r.total, 500000D, 100000D) w")


