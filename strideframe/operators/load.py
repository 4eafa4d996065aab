"""Workout, muscle-load, energy and balance analytics.

Inputs are the domain tables: ``sessions(session_id, user_id, day, minutes, calories,
completion)``, ``executions(session_id, exercise_id, sets, duration_sec, confidence)``,
``exercises(exercise_id, primary_muscle, secondary_muscle, side, met)`` and
``users(user_id, weight, age, gender)``.  Rows are reduced to (key, exercise) or
(user, day) before any join or window; windows only ever see one row per user-day,
user-week or muscle, which the calendar and the muscle list bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.functions.ladders import COMPLETION, INTENSITY, PERCENT, SECONDS, SECONDS_RATIO, ladder
from strideframe.functions.mathx import trend_pct
from strideframe.functions.timex import week_start
from strideframe.operators.keyed import pick_first
from strideframe.operators.stats import ratio


@dataclass(frozen=True)
class BodyDefaults:
    """Profile values used when a user has none, and the energy formula constants."""

    weight: float = 65.0
    gender: str = "female"
    age: int = 25
    met: float = 4.0
    female_factor: float = 0.9
    age_start: int = 20
    age_step: float = 0.005
    age_floor: float = 0.75


FEMALE = ("female", "f", "女")


def is_female(gender: Column, body: BodyDefaults = BodyDefaults()) -> Column:
    return F.lower(F.coalesce(gender, F.lit(body.gender))).isin(*FEMALE)


def met_kcal(met: Column, seconds: Column, weight: Column, gender: Column, age: Column | None, body: BodyDefaults = BodyDefaults()) -> Column:
    """Energy of one execution; without ``age`` the age factor is left out."""
    base = (
        F.coalesce(met, F.lit(body.met))
        * F.coalesce(weight, F.lit(body.weight))
        * (seconds / 3600)
        * F.when(is_female(gender, body), body.female_factor).otherwise(1.0)
    )
    if age is None:
        return base
    years = F.greatest(F.lit(0), F.coalesce(age, F.lit(body.age)) - body.age_start)
    return base * F.greatest(F.lit(body.age_floor), F.lit(1.0) - years * body.age_step)


def hr_kcal_per_minute(hr: Column, weight: Column, gender: Column, age: Column, body: BodyDefaults = BodyDefaults()) -> Column:
    """Energy per minute from the mean heart rate, never negative."""
    # Regression coefficients (intercept, heart rate, weight, age) by gender.
    female, male = (-20.4022, 0.4472, -0.1263, 0.0740), (-55.0969, 0.6309, 0.1988, 0.2017)

    def line(c: tuple[float, ...]) -> Column:
        return (F.lit(c[0]) + hr * c[1] + weight * c[2] + age * c[3]) / 4.184

    return F.greatest(F.lit(0.0), F.when(is_female(gender, body), line(female)).otherwise(line(male)))


def calories(executions: DataFrame, exercises: DataFrame, people: DataFrame, keys: Sequence[str], *, use_age: bool = True, body: BodyDefaults = BodyDefaults()) -> DataFrame:
    """MET energy per key.  ``people`` has (session_id, weight, gender, age) next to the keys."""
    work = executions.filter(F.col("duration_sec") > 0).groupBy("session_id", "exercise_id").agg(F.sum("duration_sec").alias("_sec"))
    rows = work.join(exercises.select("exercise_id", "met"), "exercise_id", "left").join(people, "session_id")
    age = F.col("age") if use_age else None
    return rows.groupBy(*keys).agg(
        F.sum(met_kcal(F.col("met"), F.col("_sec"), F.col("weight"), F.col("gender"), age, body)).alias("kcal")
    )


def label_calories(frames: DataFrame, keys: Sequence[str], gap: DataFrame, mets: DataFrame, weight: float = 65.0, default_met: float = 4.0) -> DataFrame:
    """Energy from labelled frames: every frame counts for its recording's first frame gap."""
    counts = frames.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("frames"))
    rows = counts.join(gap, list(keys)).join(mets, "label", "left")
    seconds = F.col("frames") * F.col("gap_sec")
    met = F.coalesce(F.col("met"), F.lit(default_met))
    return rows.select(*keys, "label", "frames", seconds.alias("seconds"), met.alias("met"), (met * weight * (seconds / 3600.0)).alias("kcal"))


def muscle_work(executions: DataFrame, exercises: DataFrame, keys: Sequence[str], value: Column, primary: float, secondary: float) -> DataFrame:
    """Long form: weighted value per (keys, muscle, side key)."""
    work = executions.groupBy(*keys, "exercise_id").agg(F.sum(value).alias("_v"))
    hit = F.explode(
        F.array(
            F.struct(F.col("primary_muscle").alias("muscle"), F.lit(float(primary)).alias("w")),
            F.struct(F.col("secondary_muscle").alias("muscle"), F.lit(float(secondary)).alias("w")),
        )
    )
    rows = work.join(exercises.select("exercise_id", "primary_muscle", "secondary_muscle", "side"), "exercise_id").withColumn("_h", hit)
    return rows.filter(F.col("_h.muscle").isNotNull()).select(
        *keys, F.col("_h.muscle").alias("muscle"), F.concat("side", F.col("_h.muscle")).alias("body_key"), (F.col("_v") * F.col("_h.w")).alias("score")
    )


def muscle_scores(executions: DataFrame, exercises: DataFrame, keys: Sequence[str], by: str = "muscle") -> DataFrame:
    """Sets times 2 for primary and 1 for secondary muscles; ``by='body_key'`` keeps front and back apart."""
    work = muscle_work(executions, exercises, keys, F.coalesce(F.col("sets"), F.lit(0)), 2.0, 1.0)
    return work.groupBy(*keys, by).agg(F.sum("score").alias("score"))


def share_of_total(scores: DataFrame, keys: Sequence[str], value: str = "score", out: str = "share_pct") -> DataFrame:
    """Percent of the key's total; groups without a positive value are left out."""
    kept = scores.filter(F.col(value) > 0)
    total = F.sum(value).over(Window.partitionBy(*keys))
    return kept.withColumn(out, F.col(value) / total * 100)


def share_of_top(scores: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str = "score", out: str = "relative_pct") -> DataFrame:
    """Percent of the key's largest value, with a zero for every one of ``names`` that is absent."""
    every = F.explode(F.array(*[F.lit(n) for n in names]))
    grid = scores.select(*keys).distinct().withColumn(name, every)
    full = grid.join(scores, [*keys, name], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    top = F.max(value).over(Window.partitionBy(*keys))
    return full.withColumn(out, ratio(F.col(value), top) * 100)


def rank_groups(scores: DataFrame, keys: Sequence[str], value: str = "score", out: str = "rank") -> DataFrame:
    """primary (at least half of the top), secondary or missing."""
    top = F.max(value).over(Window.partitionBy(*keys))
    return scores.withColumn(
        out, F.when(F.col(value) <= 0, "missing").when(F.col(value) >= top * 0.5, "primary").otherwise("secondary")
    )


def muscle_seconds(executions: DataFrame, exercises: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds (1 primary, 0.5 secondary); a group takes its busiest muscle, in percent of the top group."""
    work = muscle_work(executions, exercises, keys, F.col("duration_sec"), 1.0, 0.5)
    muscles = work.groupBy(*keys, "muscle").agg(F.sum("score").alias("seconds"))
    # the list of muscles is short; dealt out by muscle, all sessions' rows of a muscle would meet in one task
    grouped = muscles.join(F.broadcast(groups), "muscle").groupBy(*keys, "muscle_group").agg(F.max("seconds").alias("seconds"))
    top = F.max("seconds").over(Window.partitionBy(*keys))
    rel = ratio(F.col("seconds"), top)
    return grouped.filter(F.col("seconds") > 0).withColumns({"pct": rel * 100, "level": ladder(rel, SECONDS_RATIO)})


def weighted_muscles(actions: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted seconds per muscle with the sorted actions behind it."""
    rows = actions.join(weights, "action")
    return (
        rows.groupBy(*keys, "muscle")
        .agg(F.sum(F.col("seconds") * F.col("weight")).alias("weighted_sec"), F.array_sort(F.collect_set("action")).alias("actions"))
        .withColumn("level", ladder(F.col("weighted_sec"), SECONDS))
    )


@dataclass(frozen=True)
class BalanceParams:
    window_days: int = 7
    max_unit: int = 4
    default_confidence: float = 0.85
    guideline: float = 0.15
    structure: float = 0.40
    evidence: float = 0.20
    consistency: float = 0.25


def balance(sessions: DataFrame, executions: DataFrame, exercises: DataFrame, targets: Mapping[str, float], p: BalanceParams = BalanceParams()) -> DataFrame:
    """Rolling training-balance score for every training day of every user.

    One row per (user, day) is built first; each then feeds the following
    ``window_days`` reference days, kept only where the user trained.
    """
    rows = executions.join(sessions.select("session_id", "user_id", "day"), "session_id")
    per_ex = (
        rows.groupBy("user_id", "day", "exercise_id")
        .agg(F.coalesce(F.sum("sets"), F.lit(0)).alias("sets"), F.coalesce(F.max("confidence"), F.lit(p.default_confidence)).alias("conf"))
        .filter(F.col("sets") > 0)
        .withColumn("unit", F.least(F.col("sets"), F.lit(p.max_unit)).cast("double"))
    )
    rated = per_ex.join(exercises.select("exercise_id", "primary_muscle", "secondary_muscle"), "exercise_id", "left")
    proof = (F.col("conf") * 0.35 + 0.25 * 0.7 + F.least(F.col("unit") / 2, F.lit(1.0)) * 0.25) * F.col("unit")
    dose = F.col("unit") * F.col("conf")
    aggs = [F.sum("unit").alias("units"), F.sum(proof).alias("proof")]
    for i, g in enumerate(targets):
        first = F.coalesce(F.col("primary_muscle") == g, F.lit(False))
        second = F.coalesce(F.col("secondary_muscle") == g, F.lit(False))
        aggs.append(F.sum(F.when(first, dose).otherwise(0.0) + F.when(second, dose * 0.5).otherwise(0.0)).alias(f"e{i}"))
        aggs.append(F.max((first | second).cast("int")).alias(f"c{i}"))
    days = rated.groupBy("user_id", "day").agg(*aggs)

    trained = sessions.select("user_id", F.col("day").alias("ref_day")).distinct()
    spread = days.withColumn("ref_day", F.explode(F.sequence(F.col("day"), F.date_add("day", p.window_days - 1))))
    n = len(targets)
    sums = [F.count("day").alias("strength_days"), F.sum("units").alias("units"), F.sum("proof").alias("proof")]
    sums += [F.sum(f"e{i}").alias(f"e{i}") for i in range(n)] + [F.max(f"c{i}").alias(f"c{i}") for i in range(n)]
    win = trained.join(spread, ["user_id", "ref_day"], "left").groupBy("user_id", "ref_day").agg(*sums)

    exposure = sum((F.col(f"e{i}") for i in range(1, n)), F.col("e0"))
    covered = sum((F.col(f"c{i}") for i in range(1, n)), F.col("c0"))
    off = None
    for i, share in enumerate(targets.values()):
        d = F.abs(F.col(f"e{i}") / F.col("_exp") - share)
        off = d if off is None else off + d
    d = F.col("strength_days")
    scored = win.withColumns({"_exp": exposure, "covered": F.coalesce(covered, F.lit(0))}).withColumns(
        {
            "g": F.least(F.least(d / 2, F.lit(1.0)), F.col("covered") / n) * 100,
            "s": F.when(F.col("_exp") > 0, F.greatest(F.lit(1.0) - off * 0.5, F.lit(0.0)) * 100).otherwise(0.0),
            "e": ratio(F.col("proof") * 100, F.col("units")),
            "c": (F.least(d / 4, F.lit(1.0)) * 0.6 + F.least(F.coalesce(F.col("units"), F.lit(0.0)) / 8, F.lit(1.0)) * 0.4) * 100,
        }
    )
    none = d == 0
    score = F.col("g") * p.guideline + F.col("s") * p.structure + F.col("e") * p.evidence + F.col("c") * p.consistency
    return scored.select(
        "user_id", "ref_day", "strength_days", "covered",
        *[F.when(none, 0.0).otherwise(F.col(x)).alias(f"score_{x}") for x in "gsec"],
        F.when(none, 0.0).otherwise(F.least(score, F.lit(100.0))).alias("score"),
        F.when(none | (score <= 0), "insufficient_data").otherwise("active").alias("status"),
    )


def user_days(sessions: DataFrame, executions: DataFrame) -> DataFrame:
    """One row per user-day.  Executions are summed per session before the join, so a
    session's calories count once however many executions it has."""
    sets = executions.groupBy("session_id").agg(F.sum("sets").alias("_sets"))
    rows = sessions.join(sets, "session_id", "left")
    return rows.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(F.coalesce("_sets", F.lit(0))).alias("sets"),
        F.sum("calories").alias("kcal"),
        F.sum("minutes").alias("minutes"),
    )


def weekly(days: DataFrame) -> DataFrame:
    """Sunday-to-Saturday totals with the change against the calendar week before."""
    weeks = days.groupBy("user_id", week_start(F.col("day")).alias("week_start")).agg(
        F.sum("sets").alias("sets"), F.sum("kcal").alias("kcal"), F.sum("minutes").alias("minutes"),
        F.count_if(F.col("minutes") > 0).alias("training_days"),
    )
    w = Window.partitionBy("user_id").orderBy("week_start")
    follows = F.datediff("week_start", F.lag("week_start").over(w)) == 7
    return weeks.withColumns(
        {
            "sets_trend_pct": trend_pct(F.col("sets"), F.when(follows, F.lag("sets").over(w))),
            "kcal_trend_pct": trend_pct(F.col("kcal"), F.when(follows, F.lag("kcal").over(w))),
        }
    )


def week_grid(days: DataFrame) -> DataFrame:
    """Seven rows for every trained week, zero where there was no training."""
    start = week_start(F.col("day"))
    grid = days.select("user_id", start.alias("week_start")).distinct().withColumn(
        "day", F.explode(F.sequence(F.col("week_start"), F.date_add("week_start", 6)))
    )
    return grid.join(days, ["user_id", "day"], "left").select(
        "user_id", "week_start", "day", F.coalesce("sets", F.lit(0)).alias("sets"), F.coalesce("minutes", F.lit(0)).alias("minutes")
    )


def calendar(sessions: DataFrame, video_days: DataFrame | None = None) -> DataFrame:
    """Status per user-day: the day's last session decides; video-only days fill in."""
    last = sessions.groupBy("user_id", "day").agg(F.max_by("completion", F.struct("start_time", "session_id")).alias("_c"))
    done = last.select("user_id", "day", ladder(F.coalesce("_c", F.lit(0.0)), COMPLETION).alias("status"))
    if video_days is None:
        return done
    extra = video_days.select("user_id", "day").distinct().join(done, ["user_id", "day"], "left_anti")
    return done.unionByName(extra.withColumn("status", F.lit("video")))


def daily_summary(sessions: DataFrame) -> DataFrame:
    """The first session of every user-day."""
    return pick_first(sessions, ["user_id", "day"], ["start_time", "session_id"])


def previous_training_day(sessions: DataFrame) -> DataFrame:
    """For every user-day, the last session of the training day before."""
    days = sessions.groupBy("user_id", "day").agg(F.max_by("session_id", F.struct("start_time", "session_id")).alias("last_session"))
    w = Window.partitionBy("user_id").orderBy("day")
    return days.withColumn("prev_session", F.lag("last_session").over(w))


def trends(current: DataFrame, previous: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """up, down or flat per group of two distributions; an absent group counts as 0."""
    both = current.select(*keys, name, F.col(value).alias("_c")).join(
        previous.select(*keys, name, F.col(value).alias("_p")), [*keys, name], "full_outer"
    )
    c, p = F.coalesce("_c", F.lit(0.0)), F.coalesce("_p", F.lit(0.0))
    return both.select(*keys, name, F.when(c > p, "up").when(c < p, "down").otherwise("flat").alias("trend"))


def category_seconds(executions: DataFrame, categories: DataFrame, keys: Sequence[str], default: str = "力量") -> DataFrame:
    """Rounded seconds per category; unlisted exercises are strength work."""
    rows = executions.join(categories, "exercise_id", "left")
    return rows.groupBy(*keys, F.coalesce("category", F.lit(default)).alias("category")).agg(
        F.sum(F.floor(F.col("duration_sec") + 0.5)).alias("seconds")
    )


def rolling_insights(days: DataFrame, score: str, span: int = 30) -> DataFrame:
    """Trailing ``span`` days for each user-day: sessions, mean score, per week, relative load."""
    w = Window.partitionBy("user_id").orderBy(F.unix_date("day").cast("long")).rangeBetween(-span, 0)
    return days.select(
        "user_id", "day",
        F.sum("sessions").over(w).alias("sessions_30d"),
        F.avg(score).over(w).alias("mean_score"),
        (F.sum("sessions").over(w) / 4.3).alias("per_week"),
        F.sum("minutes").over(w).alias("minutes_30d"),
        ratio(F.col("minutes"), F.greatest(F.lit(1), F.max("minutes").over(w))).alias("relative_load"),
    )


def zone_levels(heatmap: DataFrame, zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest level of the muscles in each body zone, front and back apart."""
    level = ladder(F.col("relative_pct"), PERCENT)
    order = F.when(level == "high", 3).when(level == "med", 2).otherwise(1)
    rows = heatmap.filter(F.col("relative_pct") > 0).withColumns(
        {"back": F.col("body_key").startswith("b-"), "muscle": F.regexp_replace("body_key", "^b-", "")}
    )
    best = rows.join(zones, "muscle").groupBy(*keys, "back", "zone").agg(F.max(order).alias("_r"))
    return best.withColumn("level", F.when(F.col("_r") == 3, "high").when(F.col("_r") == 2, "med").otherwise("low")).drop("_r")


def intensity_levels(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    top = F.max("score").over(Window.partitionBy(*keys))
    return scores.withColumn("intensity", F.when(top == 0, "none").otherwise(ladder(ratio(F.col("score"), top), INTENSITY)))


def time_breakdown(segments: DataFrame, keys: Sequence[str], kind: str, start: str, end: str) -> DataFrame:
    """Seconds and share of each segment kind in its recording."""
    sums = segments.groupBy(*keys, kind).agg(F.sum(F.col(end) - F.col(start)).alias("seconds"))
    return sums.withColumn("pct", ratio(F.col("seconds") * 100, F.sum("seconds").over(Window.partitionBy(*keys))))


def activity_weeks(days: DataFrame, goal_minutes: int = 30) -> DataFrame:
    """Per user-week: mean, best day, days at goal, change in percent and active-week streak."""
    weeks = days.groupBy("user_id", week_start(F.col("day")).alias("week_start")).agg(
        F.sum("minutes").alias("minutes"),
        (F.sum("minutes") / 7).alias("day_mean"),
        F.min_by("day", F.struct((-F.col("minutes")).alias("m"), F.col("day").alias("d"))).alias("best_day"),
        F.count_if(F.col("minutes") >= goal_minutes).alias("goal_days"),
    )
    w = Window.partitionBy("user_id").orderBy("week_start")
    follows = F.coalesce(F.datediff("week_start", F.lag("week_start").over(w)) == 7, F.lit(False))
    marked = weeks.withColumns(
        {
            "change_pct": trend_pct(F.col("minutes"), F.when(follows, F.lag("minutes").over(w))),
            "_new": (~follows).cast("int"),
        }
    ).withColumn("_streak", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn(
        "streak", F.row_number().over(Window.partitionBy("user_id", "_streak").orderBy("week_start"))
    ).drop("_new", "_streak")
