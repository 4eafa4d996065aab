"""Binding of the test tables to the domain: sessions, executions, catalogue, sensor.

Each binding exists twice, as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from strideframe.functions.mathx import magnitude
from strideframe.operators.sequence import index_rows
from strideframe.plans.registry import Tables
from strideframe.session import written

DAY = 86_400.0
HOUR = 3_600.0


def users(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    level = F.element_at(
        F.array(F.lit("beginner"), F.lit("intermediate"), F.lit("advanced")), (F.col("c_nationkey") % 3 + 1).cast("int")
    )
    return t.customer.select(
        key.alias("user_id"),
        F.col("c_name").alias("user_name"),
        F.col("c_mktsegment").alias("grp"),
        (key % 60 + 50).cast("double").alias("weight"),
        (key % 50 + 18).cast("int").alias("age"),
        F.when(F.col("c_nationkey") % 2 == 0, "female").otherwise("male").alias("gender"),
        level.alias("level"),
        F.col("c_nationkey").alias("gym"),
    )


def sessions(t: Tables) -> DataFrame:
    done = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.92).otherwise(0.5)
    return t.orders.select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderdate").alias("start_time"),
        (F.col("o_orderkey") % 90 + 10).alias("minutes"),
        F.col("o_totalprice").alias("calories"),
        done.alias("completion"),
    )


def executions(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return t.lineitem.select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_partkey").alias("exercise_id"),
        F.col("l_suppkey").alias("equipment_id"),
        F.col("l_linenumber").alias("line"),
        (q % 6 + 1).cast("long").alias("sets"),
        q.cast("long").alias("reps"),
        (F.col("l_extendedprice") / 100).alias("duration_sec"),
        (1 - F.col("l_discount")).alias("confidence"),
    )


# Stand-in muscle dimension: the catalogue's six types play the muscle groups.
MUSCLES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SHARE_TARGETS = {"ECONOMY": 0.18, "LARGE": 0.18, "MEDIUM": 0.18, "PROMO": 0.16, "SMALL": 0.15, "STANDARD": 0.15}


def exercises(t: Tables) -> DataFrame:
    second = F.element_at(F.array(*[F.lit(m) for m in MUSCLES]), (F.col("p_size") % 6 + 1).cast("int"))
    return t.part.select(
        F.col("p_partkey").alias("exercise_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("primary_muscle"),
        second.alias("secondary_muscle"),
        F.when(F.col("p_partkey") % 2 == 1, "b-").otherwise("").alias("side"),
        F.col("p_brand").alias("equipment"),
        (F.col("p_size") / 5.0).alias("met"),
        F.element_at(
            F.array(F.lit("beginner"), F.lit("intermediate"), F.lit("advanced")), (F.col("p_size") % 3 + 1).cast("int")
        ).alias("difficulty"),
        F.when(F.col("p_size") % 2 == 0, "compound").otherwise("isolation").alias("exercise_type"),
    )


def samples(t: Tables) -> DataFrame:
    """The event table as a sensor stream: seconds from each recording's first row."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = t.events.groupBy("user_id").agg(F.min(micros).alias("_t0"))
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    rows = t.events.join(first, "user_id").select(
        F.col("user_id").alias("recording_id"),
        F.col("event_id").alias("row_id"),
        "ts",
        ((micros - F.col("_t0")) / 1e6).alias("t_rel"),
        v,
        F.col("event_type").alias("label"),
        k.alias("k"),
        (v / 250.0 - 1.0).alias("ax"),
        ((k - 50) / 100.0).alias("ay"),
        (v / 400.0 - 1.0).alias("az"),
        (v / 5.0).alias("gx"),
        k.cast("double").alias("gy"),
        F.lit(0.0).alias("gz"),
        (k * 3.6 - 180.0).alias("angle_x"),
        (k * 1.8).alias("angle_y"),
        F.pmod(v * 4, F.lit(360.0)).alias("angle_z"),
    )
    return rows.withColumns({"acc": magnitude(F.col("ax"), F.col("ay"), F.col("az")), "gyro": magnitude(F.col("gx"), F.col("gy"), F.col("gz"))})


def label_runs(t: Tables, index: Callable[..., DataFrame] = index_rows) -> DataFrame:
    """Runs of equal labels; a run ends where the next one starts."""
    rows = samples(t).select("recording_id", "row_id", "t_rel", "label", "k")
    indexed = index(rows, ["recording_id"], ["t_rel", "row_id"], label="label", lead=["t_rel"])
    return indexed.groupBy("recording_id", "run_id", "label").agg(
        F.min("t_rel").alias("start_sec"),
        F.max(F.coalesce("lead_t_rel", "t_rel")).alias("end_sec"),
        F.count(F.lit(1)).alias("n"),
        F.sum("k").alias("reps"),
        F.min("row_id").alias("first_row"),
    )


def settle_runs(t: Tables) -> None:
    """Write the runs once, for plans that read truth and predictions many times."""
    t.once("_runs", lambda: written(label_runs(t)))


def _runs(t: Tables) -> DataFrame:
    return t.__dict__["_runs"] if "_runs" in t.__dict__ else label_runs(t)


def truth(t: Tables) -> DataFrame:
    """Runs of positive length as ground truth."""
    return _runs(t).filter(F.col("end_sec") > F.col("start_sec")).select(
        "recording_id", F.col("run_id").alias("gt_id"), F.col("label").alias("gt_action"),
        F.col("start_sec").alias("gt_start"), F.col("end_sec").alias("gt_end"),
        F.col("n").alias("gt_sets"), F.col("reps").alias("gt_reps"),
    )


SHIFTS = {"v1": 3 * HOUR, "v2": 9 * HOUR}


def predictions(t: Tables) -> DataFrame:
    """The same runs shifted in time, with some labels and counts off: two versions."""
    version = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(s).alias("shift")) for v, s in SHIFTS.items()]))
    wrong = F.when(F.col("run_id") % 7 == 0, "other").otherwise(F.col("label"))
    return (
        _runs(t)
        .filter(F.col("end_sec") > F.col("start_sec"))
        .withColumn("_v", version)
        .select(
            F.col("_v.version").alias("version"), "recording_id", F.col("run_id").alias("pred_id"),
            wrong.alias("pred_action"),
            (F.col("start_sec") + F.col("_v.shift")).alias("pred_start"),
            (F.col("end_sec") + F.col("_v.shift")).alias("pred_end"),
            (F.col("n") + F.when(F.col("run_id") % 5 == 0, 1).otherwise(0)).alias("pred_sets"),
            (F.col("reps") + F.col("run_id") % 3).alias("pred_reps"),
        )
    )


_CTE = {
    "users": """SELECT c_custkey AS user_id, c_name AS user_name, c_mktsegment AS grp,
        CAST(c_custkey % 60 + 50 AS DOUBLE) AS weight, CAST(c_custkey % 50 + 18 AS INT) AS age,
        CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
        CASE c_nationkey % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' ELSE 'advanced' END AS level,
        c_nationkey AS gym FROM customer""",
    "sessions": """SELECT o_orderkey AS session_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day,
        o_orderdate AS start_time, o_orderkey % 90 + 10 AS minutes, o_totalprice AS calories,
        CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'P' THEN 0.92::DOUBLE ELSE 0.5::DOUBLE END AS completion
        FROM orders""",
    "executions": """SELECT l_orderkey AS session_id, l_partkey AS exercise_id, l_suppkey AS equipment_id,
        l_linenumber AS line,
        CAST(CAST(l_quantity AS INT) % 6 + 1 AS BIGINT) AS sets, CAST(l_quantity AS BIGINT) AS reps,
        l_extendedprice / 100 AS duration_sec, 1 - l_discount AS confidence FROM lineitem""",
    "exercises": """SELECT p_partkey AS exercise_id, p_name AS name, p_type AS primary_muscle,
        ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][p_size % 6 + 1] AS secondary_muscle,
        CASE WHEN p_partkey % 2 = 1 THEN 'b-' ELSE '' END AS side, p_brand AS equipment,
        p_size / 5.0::DOUBLE AS met,
        ['beginner','intermediate','advanced'][p_size % 3 + 1] AS difficulty,
        CASE WHEN p_size % 2 = 0 THEN 'compound' ELSE 'isolation' END AS exercise_type FROM part""",
    "samples": """SELECT *, sqrt(ax*ax + ay*ay + az*az) AS acc, sqrt(gx*gx + gy*gy + gz*gz) AS gyro FROM (
        SELECT user_id AS recording_id, event_id AS row_id, ts,
        CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / 1e6 AS t_rel,
        value, event_type AS label, k, value / 250.0::DOUBLE - 1.0::DOUBLE AS ax, (k - 50) / 100.0::DOUBLE AS ay,
        value / 400.0::DOUBLE - 1.0::DOUBLE AS az,
        value / 5.0::DOUBLE AS gx, CAST(k AS DOUBLE) AS gy, 0.0::DOUBLE AS gz, k * 3.6::DOUBLE - 180.0::DOUBLE AS angle_x,
        k * 1.8::DOUBLE AS angle_y, (value * 4) % 360.0::DOUBLE AS angle_z
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""",
    "flagged": """SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS chg FROM samples
        WINDOW w AS (PARTITION BY recording_id ORDER BY t_rel, row_id)""",
    "run_rows": """SELECT *, sum(chg) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS run_id FROM flagged""",
    "runs0": """SELECT recording_id, CAST(run_id AS BIGINT) AS run_id, label, min(t_rel) AS start_sec, max(t_rel) AS last_sec, count(*) AS n,
        CAST(sum(k) AS BIGINT) AS reps, min(row_id) AS first_row FROM run_rows GROUP BY ALL""",
    "label_runs": """SELECT recording_id, run_id, label, start_sec, n, reps, first_row,
        coalesce(lead(start_sec) OVER (PARTITION BY recording_id ORDER BY run_id), last_sec) AS end_sec FROM runs0""",
    "truth": """SELECT recording_id, run_id AS gt_id, label AS gt_action, start_sec AS gt_start, end_sec AS gt_end,
        n AS gt_sets, reps AS gt_reps FROM label_runs WHERE end_sec > start_sec""",
    "predictions": """SELECT version, recording_id, run_id AS pred_id,
        CASE WHEN run_id % 7 = 0 THEN 'other' ELSE label END AS pred_action,
        start_sec + shift AS pred_start, end_sec + shift AS pred_end,
        n + CASE WHEN run_id % 5 = 0 THEN 1 ELSE 0 END AS pred_sets, reps + run_id % 3 AS pred_reps
        FROM label_runs, (VALUES ('v1', 10800.0::DOUBLE), ('v2', 32400.0::DOUBLE)) s(version, shift)
        WHERE end_sec > start_sec""",
}
_NEEDS = {
    "flagged": ["samples"],
    "run_rows": ["flagged"],
    "runs0": ["run_rows"],
    "label_runs": ["runs0"],
    "truth": ["label_runs"],
    "predictions": ["label_runs"],
}


def sql(body: str, *uses: str, **ctes: str) -> str:
    """A query text with the named bindings, then the given extra expressions, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in uses:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({_CTE[n]})" for n in order] + [f"{n} AS ({c})" for n, c in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def fx(expr: str, digits: int = 6) -> str:
    """The SQL twin of :func:`strideframe.functions.mathx.fix`."""
    m = f"1e{digits}"
    return f"floor(({expr}) * {m} + 0.5::DOUBLE) / {m}"
