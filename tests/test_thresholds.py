"""Values that lie on a threshold: wrapped angles and means whose sum depends on its order."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from strideframe.functions import mathx
from strideframe.functions.sqlfuncs import register_sql
from strideframe.operators import sensor
from strideframe.streaming import monitors


def test_wrapped_angle_stays_below_180(spark):
    below = 180.0 - 6e-14  # half a turn later 360 - 6e-14, and with a turn added 720: the same direction as -180
    row = spark.createDataFrame([(below,)], "a double").select(mathx.wrap180(F.col("a")).alias("w"), mathx.circular_delta(F.col("a"), F.lit(0.0)).alias("d")).first()
    assert below < 180.0 and row.w == -180.0 and row.d == -180.0
    register_sql(spark)
    assert spark.sql(f"SELECT circular_distance({below!r}D, 0D) AS d").first().d == 180.0


ODD = [0.63, 0.04, 0.5, 0.56, 0.78, 0.98, 0.99]  # their sum from the front differs from that from the end


def _rows(spark, values, back):
    rows = [(1, i, float(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows[::-1] if back else rows, "u int, i int, t double, x double").coalesce(1)


def _means(rows):
    df = rows.withColumns({c: F.col("x") for c in ("acc", "gyro", "ax", "ay", "az", "angle_x", "angle_y", "angle_z")})
    totals = rows.groupBy("u").agg(F.lit(100.0).alias("total_sec"), F.lit(1.0).alias("fs"))
    stats = sensor.window_stats(df, ["u"], "t", "i", totals, 200.0, 200.0).first()
    feats = sensor.window_features(df.withColumn("angle_z", F.col("x") + 180.0), ["u"], "t", "i", totals, 100.0, 100.0).first()
    day = df.withColumn("ts", F.timestamp_seconds("t"))
    return stats, feats, monitors.tumbling_monitor(day.withColumn("az", F.col("x") - 0.55), "u", "1 day").first()


def test_means_follow_time_whatever_the_order_of_rows(spark):
    values = ODD
    total = reduce(add, values, 0.0)
    assert total != reduce(add, values[::-1], 0.0)
    first, second = _means(_rows(spark, values, False)), _means(_rows(spark, values, True))
    assert [m.tilt_mean for m in (first[1], second[1])] == [reduce(add, [((v + 180.0 - 180.0 + 180.0) % 360.0 + 360.0) % 360.0 - 180.0 for v in values], 0.0) / len(values)] * 2
    assert first[0].az_mean == second[0].az_mean
    assert first[0].az_mean == total / len(values) and first[0].ay_abs_mean == total / len(values)


def test_posture_on_its_threshold_follows_time(spark):
    values = [-0.05, -0.3, -0.7]  # their mean is above -0.35 in this order and below it the other way round
    rows = lambda back: _rows(spark, values, back).withColumns({"ts": F.timestamp_seconds("t"), "az": F.col("x"), "acc": F.col("x"), "gyro": F.col("x")})
    got = [monitors.tumbling_monitor(rows(back), "u", "1 day").first().posture for back in (False, True)]
    want = "仰卧" if (0.0 + values[0] + values[1] + values[2]) / 3 > -0.35 else "俯身"
    assert got == [want, want]
