"""Catalogue cleaning: derived attributes, patching, validation, repair and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions.mathx import clip
from strideframe.functions.text import DIRTY_NAME, any_keyword, is_empty, keyword_tags, strip_dirty
from strideframe.operators.stats import count_empty

# Equipment words and their tags, in order of precedence.
EQUIPMENT_WORDS = [
    ("dumbbell", "哑铃"), ("barbell", "杠铃"), ("ez bar", "EZ杠"), ("trap bar", "六角杠"), ("cable", "缆绳机"), ("smith", "史密斯架"), ("kettlebell", "壶铃"), ("band", "弹力带"),
    ("machine", "器械"), ("pull up", "单杠"), ("pull-up", "单杠"), ("pullup", "单杠"), ("chin up", "单杠"), ("chin-up", "单杠"), ("dip", "双杠"), ("suspension", "悬吊绳"),
    ("bosu", "波速球"), ("stability ball", "瑞士球"), ("foam", "泡沫轴"),
]
BODYWEIGHT_WORDS = [
    "plank", "push up", "push-up", "pushup", "burpee", "crunch", "sit up", "sit-up", "leg raise", "mountain climber", "jumping jack", "squat jump", "glute bridge", "hip bridge",
    "superman", "bird dog", "dead bug",
]
BENCH_WORDS = ["bench", "incline", "decline", "flat", " fly", "flye", "press"]
BENCH_WITH_WEIGHT_WORDS = ["bench", "incline", "decline", "flat"]
BODYWEIGHT, BARBELL, DUMBBELL, MACHINE, BENCH = "自重", "杠铃", "哑铃", "器械", "训练凳"
FALLBACK_MET = {
    ("compound", "beginner"): 4.0, ("compound", "intermediate"): 5.0, ("compound", "advanced"): 6.0,
    ("isolation", "beginner"): 3.0, ("isolation", "intermediate"): 3.5, ("isolation", "advanced"): 4.0,
    ("cardio", "beginner"): 5.0, ("cardio", "intermediate"): 6.5, ("cardio", "advanced"): 8.0,
}


def equipment_of(name: Column) -> Column:
    """Equipment tags of an exercise name; bodyweight when nothing else or by keyword,
    and a bench by keyword."""
    tags = keyword_tags(name, EQUIPMENT_WORDS)
    bare = (F.size(tags) == 0) | any_keyword(name, BODYWEIGHT_WORDS)
    with_body = F.when(bare, F.concat(F.array(F.lit(BODYWEIGHT)), tags)).otherwise(tags)
    weights = F.array_contains(tags, BARBELL) | F.array_contains(tags, DUMBBELL)
    bench = F.when(weights, any_keyword(name, BENCH_WITH_WEIGHT_WORDS)).otherwise(any_keyword(name, BENCH_WORDS))
    return F.array_distinct(F.when(bench, F.concat(with_body, F.array(F.lit(BENCH)))).otherwise(with_body))


def risk_of(difficulty: Column, equipment: Column, kind: Column) -> Column:
    barbell, machine, hard = F.array_contains(equipment, BARBELL), F.array_contains(equipment, MACHINE), difficulty == "advanced"
    return F.when(hard & barbell, "high").when(barbell | (kind == "compound"), "medium").when(machine, "low").when(hard, "medium").otherwise("low")


def met_of(kind: Column, difficulty: Column, equipment: Column) -> Column:
    base = F.when(kind == "compound", 5.0).otherwise(3.5)
    extra = F.when(difficulty == "intermediate", 0.5).when(difficulty == "advanced", 1.5).otherwise(0.0)
    return base + extra + F.when(F.array_contains(equipment, BARBELL), 1.0).otherwise(0.0)


def goals_of(movement: Column, kind: Column, difficulty: Column) -> Column:
    def goals(*xs: str) -> Column:
        return F.array(*[F.lit(x) for x in xs])

    return (
        F.when(movement == "hold", goals("核心稳定", "耐力提升"))
        .when((kind == "compound") & (difficulty == "advanced"), goals("力量提升", "增肌"))
        .when(kind == "compound", goals("增肌", "力量提升"))
        .otherwise(goals("增肌", "塑形"))
    )


def keyword_match(df: DataFrame, name: str, rules: Sequence[tuple[str, float]]) -> Column:
    """Value of the first keyword that occurs in a name; NULL without one."""
    low, out = F.lower(F.trim(F.col(name))), None
    for word, value in rules:
        out = F.when(low.contains(word), F.lit(value)) if out is None else out.when(low.contains(word), F.lit(value))
    return F.lit(None).cast("double") if out is None else out


def patch_mets(df: DataFrame, local_names: DataFrame, exact_names: DataFrame, keywords: Sequence[tuple[str, float]], default: float = 4.0) -> DataFrame:
    """Standard MET by priority: local name, exact name, keyword, type and level, default.
    ``local_names`` and ``exact_names`` have (key, met)."""
    local = local_names.select(F.col("key").alias("name_local"), F.col("met").alias("_m1"))
    exact = exact_names.select(F.col("key").alias("_low"), F.col("met").alias("_m2"))
    kind, level = F.coalesce(F.nullif("exercise_type", F.lit("")), F.lit("compound")), F.coalesce(F.nullif("difficulty", F.lit("")), F.lit("beginner"))
    pairs = []
    for (k, d), met in FALLBACK_MET.items():
        pairs += [F.lit(f"{k}/{d}"), F.lit(met)]
    by_type = F.try_element_at(F.create_map(*pairs), F.concat_ws("/", kind, level))
    rows = df.withColumn("_low", F.lower(F.trim("name"))).join(local, "name_local", "left").join(exact, "_low", "left")
    return rows.withColumn("met", F.coalesce("_m1", "_m2", keyword_match(rows, "name", keywords), by_type, F.lit(default))).drop("_low", "_m1", "_m2")


def fill_when_empty(df: DataFrame, reference: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Take a reference value only where the stored field is empty."""
    ref = reference.select(*on, *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = df.join(ref, list(on), "left")
    return joined.withColumns({f: F.when(is_empty(df, f), F.coalesce(f"_r_{f}", f)).otherwise(F.col(f)) for f in fields}).select(*df.columns)


def issues(checks: Mapping[str, Column]) -> Column:
    """Array of the names of the checks that fail; a NULL check does not fail."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def recognition_issues(r: Column) -> Column:
    """Problems of a raw recognition result whose fields are text as received.

    ``r`` is a struct of (exercise, equipment, confidence, sets_json, total_sets, total_reps)."""
    number = r["confidence"].try_cast("double")
    reps = F.from_json(r["sets_json"], "array<struct<reps:string>>")
    return issues(
        {
            "exercise_illegal_chars": r["exercise"].rlike(DIRTY_NAME),
            "equipment_illegal_chars": r["equipment"].rlike(DIRTY_NAME),
            "confidence_not_numeric": r["confidence"].isNotNull() & number.isNull(),
            "confidence_out_of_range": (number < 0) | (number > 1),
            "sets_not_list": r["sets_json"].isNotNull() & ~F.trim(r["sets_json"]).startswith("["),
            "set_reps_not_numeric": F.exists(reps, lambda s: s["reps"].isNotNull() & s["reps"].try_cast("double").isNull()),
            "total_sets_not_numeric": r["total_sets"].isNotNull() & r["total_sets"].try_cast("double").isNull(),
            "total_reps_not_numeric": r["total_reps"].isNotNull() & r["total_reps"].try_cast("double").isNull(),
        }
    )


def catalogue_issues(met: Column, secondary: Column, valid: Column) -> Column:
    """Problems of enriched catalogue fields: MET range, odd muscle ids."""
    return issues(
        {
            "met_not_numeric": met.isNotNull() & met.try_cast("double").isNull(),
            "met_out_of_range": ~met.try_cast("double").between(1.0, 15.0),
            "secondary_illegal_chars": F.exists(secondary, lambda m: m.rlike(DIRTY_NAME)),
            "secondary_joined_ids": F.exists(secondary, lambda m: m.contains("_") & ~F.array_contains(valid, m)),
        }
    )


def repair_result(r: Column) -> Column:
    """Cleaned recognition result: text stripped, confidence clipped, counts whole, totals
    derived from the sets where absent."""
    def whole(c: Column) -> Column:
        return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))

    sets = F.coalesce(F.transform(F.from_json(r["sets_json"], "array<struct<reps:string>>"), lambda s: F.struct(whole(s["reps"]).alias("reps"))), F.array().cast("array<struct<reps:int>>"))
    return F.struct(
        strip_dirty(r["exercise"], DIRTY_NAME).alias("exercise"),
        strip_dirty(r["equipment"], DIRTY_NAME).alias("equipment"),
        F.coalesce(clip(r["confidence"].try_cast("double"), 0.0, 1.0), F.lit(0.0)).alias("confidence"),
        sets.alias("sets"),
        F.coalesce(F.when(r["total_sets"].isNotNull(), whole(r["total_sets"])), F.size(sets)).alias("total_sets"),
        F.coalesce(F.when(r["total_reps"].isNotNull(), whole(r["total_reps"])), F.aggregate(sets, F.lit(0), lambda a, s: a + s["reps"])).alias("total_reps"),
    )


def backfill(df: DataFrame, best: DataFrame, on: Sequence[str], column: str, default: float = 0.85) -> DataFrame:
    """Replace a missing or default value by the best known one of its key."""
    known = best.select(*on, F.col(column).alias("_best"))
    stale = F.col(column).isNull() | (F.col(column) == default)
    return df.join(known, list(on), "left").withColumn(column, F.when(stale, F.coalesce("_best", column)).otherwise(F.col(column))).drop("_best")


def retry_worklist(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where a name is blank or says unknown anywhere."""
    bad = None
    for c in columns:
        t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
        test = (t == "") | t.contains("UNKNOWN")
        bad = test if bad is None else bad | test
    return results.filter(bad)


def accept_retries(results: DataFrame, retried: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Retried rows replace the old ones only if they are known now."""
    from strideframe.operators.keyed import prefer

    good = retried.join(retry_worklist(retried, columns).select(*keys), list(keys), "left_anti")
    return prefer([good, results], keys)


def quality_report(df: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Empty fields and duplicated keys as (field, n_empty) rows."""
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n_empty")).select(F.lit("duplicate_keys").alias("field"), "n_empty")
    return count_empty(df, fields).unionByName(dup)
