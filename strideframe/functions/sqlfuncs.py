"""Register the scalar helpers as SQL functions, so that plain SQL can call them."""

from __future__ import annotations

from pyspark.sql import SparkSession, types as T
from pyspark.sql.functions import udtf

_FUNCTIONS = {
    "circular_distance": "(a DOUBLE, t DOUBLE) RETURNS DOUBLE RETURN abs(((a - t + 180D) % 360D + 360D) % 360D - 180D)",
    "interval_iou": """(s1 DOUBLE, e1 DOUBLE, s2 DOUBLE, e2 DOUBLE) RETURNS DOUBLE RETURN
        CASE WHEN (e1 - s1) + (e2 - s2) - greatest(0D, least(e1, e2) - greatest(s1, s2)) <= 0 THEN 0D
        ELSE greatest(0D, least(e1, e2) - greatest(s1, s2))
             / ((e1 - s1) + (e2 - s2) - greatest(0D, least(e1, e2) - greatest(s1, s2))) END""",
    "hms_to_sec": """(t STRING) RETURNS DOUBLE RETURN
        CASE size(split(trim(t), ':'))
          WHEN 3 THEN try_cast(get(split(trim(t), ':'), 0) AS DOUBLE) * 3600
                    + try_cast(get(split(trim(t), ':'), 1) AS DOUBLE) * 60
                    + try_cast(get(split(trim(t), ':'), 2) AS DOUBLE)
          WHEN 2 THEN try_cast(get(split(trim(t), ':'), 0) AS DOUBLE) * 60
                    + try_cast(get(split(trim(t), ':'), 1) AS DOUBLE)
          ELSE try_cast(trim(t) AS DOUBLE) END""",
    "vec_cosine": """(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN
        aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)
        / (sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x)))
           * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x))) + 1e-9D)""",
    "gyro_label": """(g DOUBLE) RETURNS STRING RETURN
        CASE WHEN g > 30 THEN '高强度运动' WHEN g > 10 THEN '中等运动' WHEN g > 3 THEN '轻微运动' ELSE '静止/休息' END""",
}


@udtf(
    returnType=T.StructType(
        [T.StructField("k", T.LongType()), T.StructField("start_sec", T.DoubleType()), T.StructField("end_sec", T.DoubleType())]
    )
)
class Windows:
    """``windows(total, size, overlap)``: overlapping windows that cover a duration."""

    def eval(self, total: float, size: float, overlap: float):
        k, start = 0, 0.0
        while start < total:
            end = min(start + size, total)
            yield k, start, end
            if end >= total:
                return
            k, start = k + 1, start + size - overlap


def register_sql(spark: SparkSession) -> list[str]:
    """Create the temporary functions in a session; returns their names."""
    for name, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("windows", Windows)
    return [*_FUNCTIONS, "windows"]
