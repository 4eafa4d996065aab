"""Catalogue cleaning, name resolution and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import text
from strideframe.operators import catalog, names
from strideframe.plans import bindings as b
from strideframe.plans.bindings import fx, sql
from strideframe.plans.registry import query

_SEEN = """SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'x ' || p_name WHEN 2 THEN replace(p_name, 'i', 'e') WHEN 3 THEN reverse(p_name) ELSE substr(p_name, 3) END AS seen FROM part"""
_CAT = "SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY ALL"


def _seen(t):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    return t.part.select(F.when(k == 0, n).when(k == 1, F.concat(F.lit("x "), n)).when(k == 2, F.replace(n, F.lit("i"), F.lit("e"))).when(k == 3, F.reverse(n)).otherwise(F.substring(n, 3, 200)).alias("seen")).distinct()


def _resolved(t):
    cat = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return names.resolve(_seen(t), cat, "seen", "name", "ord")


_RESOLVE = """SELECT s.seen, coalesce(b.name, s.seen) AS matched, coalesce(b.stage, 0) AS stage FROM seen s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seen ORDER BY stage, dist, ord) AS rn FROM (
      SELECT seen, name, ord, CASE WHEN seen = name THEN 1 WHEN (contains(seen, name) OR contains(name, seen)) AND abs(length(seen) - length(name)) <= 3 THEN 2 ELSE 3 END AS stage,
        CASE WHEN (contains(seen, name) OR contains(name, seen)) AND abs(length(seen) - length(name)) <= 3 THEN 0 ELSE levenshtein(seen, name) END AS dist FROM seen, cat) WHERE stage < 3 OR dist <= 2) WHERE rn = 1) b USING (seen)"""


@query("n01_name_resolution", sql(_RESOLVE, seen=_SEEN, cat=_CAT))
def n01(t):
    return _resolved(t).select("seen", "matched", "stage")


@query("c14_edit_distance_join", sql("SELECT seen, name, CAST(levenshtein(seen, name) AS INT) AS dist FROM seen, cat WHERE levenshtein(seen, name) <= 2", seen=_SEEN, cat=_CAT))
def c14(t):
    left = _seen(t).withColumn("_d", F.explode(names.deletions(F.col("seen"))))
    cat = t.part.select(F.col("p_name").alias("name")).distinct()
    pairs = left.join(cat.withColumn("_d", F.explode(names.deletions(F.col("name")))), "_d").select("seen", "name").distinct()
    return pairs.withColumn("dist", F.levenshtein("seen", "name")).filter("dist <= 2")


@query("n03_substitutions", sql(f"SELECT seen, matched FROM ({_RESOLVE}) WHERE seen <> matched", seen=_SEEN, cat=_CAT))
def n03(t):
    return names.substitutions(_resolved(t), "seen")


_MAPPING = "SELECT s_suppkey AS id, p1.p_name || '/' || p2.p_name AS title FROM supplier JOIN part p1 ON p1.p_partkey = s_suppkey JOIN part p2 ON p2.p_partkey = s_suppkey * 2 + 1"
_ALIASES = """SELECT alias, min(place) AS place, arg_max(id, place) AS id, arg_max(title, place) AS title FROM (SELECT id, title, a AS alias, (id, i) AS place FROM (
      SELECT id, title, trim(split_part(title, '/', 1)) AS a, 0 AS i FROM mapping UNION ALL SELECT id, title, trim(split_part(title, '/', 2)), 1 FROM mapping UNION ALL SELECT id, title, title, 2 FROM mapping UNION ALL SELECT id, title, CAST(id AS VARCHAR), 3 FROM mapping)) GROUP BY alias"""


@query("n02_alias_resolution", sql("""SELECT s.seen, b.id, coalesce(b.title, s.seen) AS standard_name FROM seen s LEFT JOIN (SELECT * FROM (SELECT seen, id, title, row_number() OVER (PARTITION BY seen ORDER BY seen <> alias, place) AS rn FROM seen, aliases WHERE contains(seen, alias) OR contains(alias, seen)) WHERE rn = 1) b USING (seen)""",
    seen=_SEEN, mapping=_MAPPING, aliases=_ALIASES))
def n02(t):
    p1 = t.part.select(F.col("p_partkey").alias("s_suppkey"), F.col("p_name").alias("n1"))
    p2 = t.part.select(F.col("p_partkey").alias("_k"), F.col("p_name").alias("n2"))
    m = t.supplier.select("s_suppkey").join(p1, "s_suppkey").join(p2, F.col("_k") == F.col("s_suppkey") * 2 + 1)
    mapping = m.select(F.col("s_suppkey").alias("id"), F.concat_ws("/", "n1", "n2").alias("title"))
    aliases = names.alias_table(mapping.withColumn("ord", F.col("id")), "id", "title", "ord")
    return names.resolve_alias(_seen(t), aliases, "seen", "id", "title").select("seen", "id", "standard_name")


@query("n04_default_patch", sql(f"""SELECT exercise_id, {fx("coalesce(CASE WHEN name = 'red bolt' THEN 9.0::DOUBLE END, CASE WHEN lower(trim(name)) = 'hot gear' THEN 7.5::DOUBLE END, CASE WHEN contains(name, 'ring') THEN 6.0::DOUBLE WHEN contains(name, 'small') THEN 2.0::DOUBLE END, CASE exercise_type WHEN 'compound' THEN CASE difficulty WHEN 'beginner' THEN 4.0::DOUBLE WHEN 'intermediate' THEN 5.0 ELSE 6.0 END ELSE CASE difficulty WHEN 'beginner' THEN 3.0::DOUBLE WHEN 'intermediate' THEN 3.5 ELSE 4.0 END END, 4.0)")} AS met FROM exercises""", "exercises"))
def n04(t):
    ex = b.exercises(t).withColumn("name_local", F.col("name"))
    local = t.spark.createDataFrame([("red bolt", 9.0)], "key string, met double")
    exact = t.spark.createDataFrame([("hot gear", 7.5)], "key string, met double")
    return catalog.patch_mets(ex.drop("met"), local, exact, [("ring", 6.0), ("small", 2.0)]).select("exercise_id", "met")


@query("n04_fill_when_empty", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR lang IS NULL THEN coalesce('from_' || source, '') ELSE lang END AS lang FROM documents")
def n04b(t):
    docs = t.documents.select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("lang"))
    ref = t.documents.select("doc_id", F.concat(F.lit("from_"), "source").alias("lang"))
    return catalog.fill_when_empty(docs, ref, ["doc_id"], ["lang"]).select("doc_id", "lang")


_N05NAME = "CASE p_partkey % 6 WHEN 0 THEN 'Barbell Bench ' || p_name WHEN 1 THEN 'Push-Up ' || p_name WHEN 2 THEN 'Cable Fly ' || p_name WHEN 3 THEN 'Machine Press ' || p_name WHEN 4 THEN 'Dumbbell Press ' || p_name ELSE p_name END"


@query("n05_derived_attributes", f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '杠铃,训练凳' WHEN 1 THEN '自重' WHEN 2 THEN '缆绳机,训练凳' WHEN 3 THEN '器械,训练凳' WHEN 4 THEN '哑铃' ELSE '自重' END AS equipment,
      CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN lvl = 2 THEN 'high' ELSE 'medium' END WHEN cmp THEN 'medium' WHEN p_partkey % 6 = 3 THEN 'low' WHEN lvl = 2 THEN 'medium' ELSE 'low' END AS risk,
      CASE WHEN cmp THEN 5.0::DOUBLE ELSE 3.5::DOUBLE END + CASE lvl WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS met,
      CASE WHEN cmp AND lvl = 2 THEN '力量提升,增肌' WHEN cmp THEN '增肌,力量提升' ELSE '增肌,塑形' END AS goals FROM (SELECT p_partkey, p_size % 3 AS lvl, p_size % 2 = 0 AS cmp FROM part)""")
def n05(t):
    k = F.col("p_partkey") % 6
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("Barbell Bench ", "Push-Up ", "Cable Fly ", "Machine Press ", "Dumbbell Press ", "")]), (k + 1).cast("int"))
    name = F.concat(prefix, "p_name")
    level = F.element_at(F.array(F.lit("beginner"), F.lit("intermediate"), F.lit("advanced")), F.col("p_size") % 3 + 1)
    kind = F.when(F.col("p_size") % 2 == 0, "compound").otherwise("isolation")
    eq = catalog.equipment_of(name)
    return t.part.select(
        "p_partkey", F.array_join(eq, ",").alias("equipment"), catalog.risk_of(level, eq, kind).alias("risk"), catalog.met_of(kind, level, eq).alias("met"),
        F.array_join(catalog.goals_of(F.lit("push"), kind, level), ",").alias("goals"))


@query("n06_muscle_map", sql("""SELECT exercise_id, CASE WHEN primary_muscle IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN primary_muscle END AS front, CASE WHEN primary_muscle IN ('MEDIUM', 'PROMO', 'SMALL', 'STANDARD') THEN primary_muscle END AS back,
      CASE WHEN primary_muscle = secondary_muscle THEN 1 ELSE 2 END AS n_clean FROM exercises""", "exercises"))
def n06(t):
    valid = F.array(*[F.lit(m) for m in b.MUSCLES])
    front, back = (F.array(*[F.lit(m) for m in ms]) for ms in (("ECONOMY", "LARGE", "MEDIUM"), ("MEDIUM", "PROMO", "SMALL", "STANDARD")))
    raw = F.array(F.concat("primary_muscle", F.lit("?")), F.concat("primary_muscle", F.lit("_"), "secondary_muscle"), F.lit("nonsense"))
    ids = text.split_ids(raw, valid)
    main = F.slice(ids, 1, 1)
    return b.exercises(t).select(
        "exercise_id", F.get(text.keep_members(main, front), F.lit(0)).alias("front"), F.get(text.keep_members(main, back), F.lit(0)).alias("back"), F.size(ids).alias("n_clean"))


def _raw(t):
    m, k = F.col("event_id") % 5, F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", F.struct(
        F.when(m == 0, "row?er").otherwise(F.col("event_type")).alias("exercise"), F.lit("bar").alias("equipment"),
        F.when(m == 1, "high").otherwise((F.col("value") / 200).cast("string")).alias("confidence"),
        F.when(m == 2, F.lit("3")).otherwise(F.concat(F.lit('[{"reps":'), k.cast("string"), F.lit('},{"reps":"x"}]'))).alias("sets_json"),
        F.when(m == 3, "two").alias("total_sets"), F.when(m == 4, k.cast("string")).alias("total_reps")).alias("r"))


@query("n07_validation", """SELECT event_id, concat_ws(',', CASE WHEN m = 0 THEN 'exercise_illegal_chars' END, CASE WHEN m = 1 THEN 'confidence_not_numeric' END, CASE WHEN m <> 1 AND value / 200 > 1 THEN 'confidence_out_of_range' END, CASE WHEN m = 2 THEN 'sets_not_list' END,
      CASE WHEN m <> 2 THEN 'set_reps_not_numeric' END, CASE WHEN m = 3 THEN 'total_sets_not_numeric' END) AS errors FROM (SELECT *, event_id % 5 AS m FROM events)""")
def n07(t):
    return _raw(t).select("event_id", F.array_join(catalog.recognition_issues(F.col("r")), ",").alias("errors"))


@query("n08_repair", f"""SELECT event_id, CASE WHEN m = 0 THEN 'rower' ELSE event_type END AS exercise, CASE WHEN m = 1 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, value / 200) END AS confidence,
      CASE m WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 2 END AS total_sets, CASE m WHEN 2 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS total_reps FROM (SELECT *, event_id % 5 AS m FROM events)""")
def n08(t):
    r = catalog.repair_result(F.col("r"))
    return _raw(t).select("event_id", r.alias("c")).select("event_id", "c.exercise", "c.confidence", "c.total_sets", "c.total_reps")


@query("n09_backfill", sql("""SELECT session_id, line, exercise_id, count(*) AS n, max(CASE WHEN confidence IS NULL OR confidence = 0.95::DOUBLE THEN coalesce(best, confidence) ELSE confidence END) AS confidence
    FROM executions LEFT JOIN (SELECT exercise_id, max(confidence) AS best FROM executions WHERE confidence < 0.95 GROUP BY ALL) USING (exercise_id) GROUP BY ALL""", "executions"))
def n09(t):
    e = b.executions(t).select("session_id", "line", "exercise_id", "confidence")
    best = e.filter("confidence < 0.95D").groupBy("exercise_id").agg(F.max("confidence").alias("confidence"))
    return catalog.backfill(e, best, ["exercise_id"], "confidence", 0.95).groupBy("session_id", "line", "exercise_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


@query("n10_quality_report", """SELECT 'quality' AS field, count(*) FILTER (quality IS NULL) AS n_empty FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'source', count(*) FILTER (source IS NULL OR trim(source) = '') FROM documents
    UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT lang, source FROM documents GROUP BY ALL HAVING count(*) > 1)""")
def n10(t):
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    return catalog.quality_report(rows, ["lang", "source"], ["quality", "source"])


_RES = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Unknown_action' WHEN event_id % 4 = 1 THEN ' ' ELSE event_type END AS exercise, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'bar' END AS equipment FROM events"


def _res(t):
    m = F.col("event_id")
    return t.events.select("event_id", F.when(m % 4 == 0, "Unknown_action").when(m % 4 == 1, " ").otherwise(F.col("event_type")).alias("exercise"), F.when(m % 6 == 0, "").otherwise("bar").alias("equipment"))


@query("n11_retry_worklist", sql("SELECT event_id FROM r WHERE trim(exercise) = '' OR contains(upper(exercise), 'UNKNOWN') OR trim(equipment) = ''", r=_RES))
def n11(t):
    return catalog.retry_worklist(_res(t), ["exercise", "equipment"]).select("event_id")


@query("n11_accept_retries", sql("SELECT event_id, CASE WHEN hit THEN 'retry' ELSE exercise END AS exercise FROM (SELECT *, (trim(exercise) = '' OR contains(upper(exercise), 'UNKNOWN') OR trim(equipment) = '') AND event_id % 3 = 0 AS hit FROM r)", r=_RES))
def n11b(t):
    res = _res(t)
    work = catalog.retry_worklist(res, ["exercise", "equipment"])
    ok = F.col("event_id") % 3 == 0
    retried = work.select("event_id", F.when(ok, "retry").otherwise("unknown").alias("exercise"), F.lit("bar").alias("equipment"))
    return catalog.accept_retries(res, retried, ["event_id"], ["exercise", "equipment"]).select("event_id", "exercise")


@query("n12_level_lists", sql("SELECT difficulty, equipment, count(*) AS n, count(*) FILTER (exercise_type = 'compound') AS mvp FROM exercises WHERE difficulty IN ('beginner', 'intermediate') GROUP BY ALL", "exercises"))
def n12(t):
    ex = b.exercises(t).filter(F.col("difficulty").isin("beginner", "intermediate"))
    return ex.groupBy("difficulty", "equipment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("exercise_type") == "compound").alias("mvp"))
