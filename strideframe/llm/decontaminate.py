"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names (capitalised words, wherever they stand; names parted by one blank are one) and units after
numbers become typed placeholders.  Every window of ``WINDOW`` canonical words of a benchmark item that holds at least ``LITERAL`` plain words is hash-joined
with the windows of all documents.  Matching windows of one document and item on one
diagonal (document position minus item position) are one alignment.  An alignment counts when it
holds at least ``SHARE`` of the item's windows or ``RUN`` words' worth of windows, and when its slots are
consistent: each slot value of the item stands for one value in the document (two may stand for the same), with
exceptions at no more than ``EXCEPTIONS`` percent of the slots.  ``RUN`` words' worth of windows whose slots hold the item's own values
count whatever the other slots hold.  Equal values make an exact leak, other values a re-parameterised question.

Defined cases: a null or empty text has no window and is clean; an item of fewer than
``WINDOW`` words, or without a window of ``LITERAL`` plain words, matches nothing; ties between items go to more
matched windows, then the smaller item id; rows that repeat a document each get its verdict; items
that repeat count once per id; empty tables give no hits.  Only the named columns are read, whatever
other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.registry import query, table
from strideframe.llm.scratch import run_folder, settled, without_keys

WINDOW, LITERAL, SHARE, RUN, EXCEPTIONS = 5, 3, 0.8, 13, 20
#: Benchmark windows up to this number are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
# Units that may follow a number.
UNITS = "kg g mg km m cm mm l ml s ms min h hr hrs hour hours minutes seconds days years miles mile feet ft inches inch pounds lb lbs dollars euros cents percent"

_NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
_WORD = r"[\p{L}\p{M}\p{N}]+"
_N, _A, _U = "\x01", "\x02", "\x03"
_NAME = r"(^|[^\p{L}\p{M}\p{N}])(\p{Lu}\p{Ll}+)"
_NAMES = f"{_A}{_WORD}(?: {_A}{_WORD})*"
_UNIT = rf"({_NUMBER} ?)({'|'.join(UNITS.split())})([^\p{{L}}\p{{M}}\p{{N}}]|$)"


def marked(text: Column) -> Column:
    """The text with a mark before each number, name and unit."""
    t = F.translate(text, _N + _A + _U, "   ")
    t = F.regexp_replace(t, _NAME, f"$1{_A}$2")
    t = F.regexp_replace(t, _UNIT, f"$1 {_U}$2$3")
    return F.regexp_replace(t, f"({_NUMBER})", f"{_N}$1")


def surface_words(mark: Column) -> Column:
    """The words of a marked text; a slot keeps its mark and value."""
    return F.regexp_extract_all(mark, F.lit(f"{_N}{_NUMBER}|{_NAMES}|{_U}?{_WORD}"), F.lit(0))


def template_words(mark: Column) -> Column:
    """The same words in lower case, each slot as its bare mark."""
    t = F.regexp_replace(mark, f"{_N}{_NUMBER}", _N)
    t = F.lower(F.regexp_replace(F.regexp_replace(t, _NAMES, _A), f"{_U}{_WORD}", _U))
    return F.regexp_extract_all(t, F.lit(f"[{_N}{_A}{_U}]|{_WORD}"), F.lit(0))


def _windows(words: str) -> Column:
    """Hashes of all windows of an array column of at least ``WINDOW`` words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(words), i, WINDOW)))


def _item_windows(bench: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, item_at, h: the windows of all items with enough plain words."""
    items = bench.select(F.col(item_id).alias("item_id"), marked(F.col(text)).alias("mark")).where("mark is not null").select("item_id", template_words(F.col("mark")).alias("w")).where(F.size("w") >= WINDOW)
    plain = F.size(F.filter(F.slice(F.col("w"), F.col("item_at") + 1, WINDOW), lambda x: ~x.isin(_N, _A, _U)))
    return items.select("item_id", "w", F.posexplode(_windows("w")).alias("item_at", "h")).where(plain >= LITERAL).select("item_id", "item_at", "h").distinct()


def alignments(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, h_text, item_id, shift, matched, of, kind: each alignment that counts, with ``kind`` exact or reparameterised."""
    folder = run_folder(docs.sparkSession)
    items = settled(_item_windows(bench, item_id, item_text), folder, "items")
    hashes = items.select("h").distinct()
    if items.count() <= BROADCAST_WINDOWS:
        hashes = F.broadcast(hashes)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    keyed = source.select("doc_id", F.xxhash64("text").alias("h_text"), marked(F.col("text")).alias("mark"))
    windows = keyed.select("doc_id", "h_text", template_words(F.col("mark")).alias("w")).where(F.size("w") >= WINDOW).select("doc_id", "h_text", F.posexplode(_windows("w")).alias("at", "h"))
    hits = settled(windows.join(hashes, "h"), folder, "hits")
    usable = items.groupBy("item_id").agg(F.count("*").alias("of"))
    runs = (
        hits.join(items, "h").groupBy("doc_id", "h_text", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.countDistinct("item_at").alias("matched"), F.collect_set("item_at").alias("item_ats"))
        .join(usable, "item_id").where(F.col("matched") >= F.least(F.ceil(F.col("of") * SHARE), F.lit(RUN - WINDOW + 1)))
    )
    runs = settled(runs, folder, "runs")
    touched = runs.select("doc_id", "h_text").distinct()
    same = [F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")), F.col("d.h_text") == F.col("t.h_text")]
    of_docs = keyed.alias("d").join(touched.alias("t"), same, "left_semi").select("doc_id", "h_text", surface_words(F.col("mark")).alias("doc_words")).dropDuplicates(["doc_id", "h_text"])
    of_items = bench.select(F.col(item_id).alias("item_id"), surface_words(marked(F.col(item_text))).alias("item_words")).dropDuplicates(["item_id"])
    covered = F.array_distinct(F.flatten(F.transform("item_ats", lambda a: F.sequence(a, a + (WINDOW - 1)))))
    pair = lambda p: (F.element_at("item_words", p + 1), F.element_at("doc_words", p + F.col("shift") + 1))
    slot = lambda word: F.substring(word, 1, 1).isin(_N, _A, _U)
    slots = F.filter(F.transform(covered, lambda p: F.struct(pair(p)[0].alias("i"), pair(p)[1].alias("d"))), lambda s: slot(s["i"]))
    verbatim = F.size(F.filter("item_ats", lambda a: ~F.exists(F.sequence(a, a + (WINDOW - 1)), lambda p: slot(pair(p)[0]) & (pair(p)[0] != pair(p)[1]))))
    near = [F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")), F.col("r.h_text") == F.col("d.h_text")]
    found = runs.alias("r").join(of_docs.alias("d"), near).join(of_items.alias("i"), F.col("r.item_id").eqNullSafe(F.col("i.item_id"))).select("r.*", verbatim.alias("verbatim"), slots.alias("slots"))
    keys = ["doc_id", "h_text", "item_id", "shift", "matched", "of", "verbatim"]
    pairs = found.select(*keys, F.explode_outer("slots").alias("s")).groupBy(*keys, F.col("s.i").alias("i"), F.col("s.d").alias("d")).agg(F.count("s").alias("n"))
    values = pairs.groupBy(*keys, "i").agg(F.max("n").alias("agree"), F.sum("n").alias("n"), F.sum(F.when(F.col("i") != F.col("d"), F.col("n")).otherwise(0)).alias("other"))
    judged = values.groupBy(*keys).agg(F.sum("agree").alias("agree"), F.sum("n").alias("n"), F.sum("other").alias("other"))
    consistent = 100 * (F.col("n") - F.col("agree")) <= EXCEPTIONS * F.col("n")
    return judged.where(consistent | (F.col("verbatim") > RUN - WINDOW)).select("doc_id", "h_text", "item_id", "shift", "matched", "of", F.when(F.col("other") == 0, "exact").otherwise("reparameterised").alias("kind"))


def decontaminate(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, and of its best alignment item_id, kind, matched, of; n_items counts its items."""
    best = alignments(docs, bench, doc_id, text, item_id, item_text).groupBy("doc_id", "h_text").agg(
        F.min_by(F.struct("item_id", "kind", "matched", "of"), F.struct(-F.col("matched"), "item_id", "shift")).alias("best"), F.countDistinct("item_id").alias("n_items")
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h_text"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("d.h_text") == F.col("b.h_text")]
    return rows.alias("d").join(best.alias("b"), same, "left").select(
        "d.doc_id", F.col("best").isNotNull().alias("contaminated"), F.col("best.item_id").alias("item_id"), F.col("best.kind").alias("kind"),
        F.coalesce("best.matched", F.lit(0)).cast("long").alias("matched"), F.coalesce("best.of", F.lit(0)).cast("long").alias("of"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )


def without_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    leaks = settled(alignments(docs, bench).select("doc_id", "h_text").distinct(), run_folder(docs.sparkSession), "leaks")
    return without_keys(docs, leaks)


_SQL_MARK = "regexp_replace(regexp_replace(regexp_replace(translate(text, chr(1) || chr(2) || chr(3), '   '), '{name}', '\\1' || chr(2) || '\\2', 'g'), '{unit}', '\\1 ' || chr(3) || '\\2\\3', 'g'), '({number})', chr(1) || '\\1', 'g')".format(name=_NAME, unit=_UNIT, number=_NUMBER)
_SQL_NAMES = "chr(2) || '{word}(?: ' || chr(2) || '{word})*'".format(word=_WORD)
_SQL_TEMPLATE = "regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(mark, chr(1) || '{number}', chr(1), 'g'), {names}, chr(2), 'g'), chr(3) || '{word}', chr(3), 'g')), '[' || chr(1) || chr(2) || chr(3) || ']|{word}')".format(number=_NUMBER, names=_SQL_NAMES, word=_WORD)
_SQL_SURFACE = "regexp_extract_all(mark, chr(1) || '{number}|' || {names} || '|' || chr(3) || '?{word}')".format(number=_NUMBER, names=_SQL_NAMES, word=_WORD)
_SQL_SLOT = "b.surface[p][1] IN (chr(1), chr(2), chr(3))"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_SURFACE} AS surface, {_SQL_TEMPLATE} AS w FROM (SELECT doc_id, {_SQL_MARK} AS mark FROM documents)),
b AS (SELECT item_id, {_SQL_SURFACE} AS surface, {_SQL_TEMPLATE} AS w FROM (SELECT item_id, {_SQL_MARK} AS mark FROM benchmark)),
bw AS (SELECT item_id, k0, win FROM (SELECT item_id, k0, w[k0:k0 + {WINDOW - 1}] AS win FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS k0 FROM b WHERE len(w) >= {WINDOW}))
  WHERE len(list_filter(win, lambda x: x NOT IN (chr(1), chr(2), chr(3)))) >= {LITERAL}),
dw AS (SELECT doc_id, k0, w[k0:k0 + {WINDOW - 1}] AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS k0 FROM d WHERE len(w) >= {WINDOW})),
runs AS (SELECT doc_id, item_id, dw.k0 - bw.k0 AS shift, count(DISTINCT bw.k0) AS matched, list(DISTINCT bw.k0) AS ats FROM dw JOIN bw USING (win) GROUP BY ALL),
big AS (SELECT runs.*, n AS of_ FROM runs JOIN (SELECT item_id, count(*) AS n FROM bw GROUP BY item_id) USING (item_id) WHERE matched >= least(ceil(n * {SHARE}), {RUN - WINDOW + 1})),
pos AS (SELECT DISTINCT doc_id, item_id, shift, unnest(flatten(list_transform(ats, lambda a: generate_series(a, a + {WINDOW - 1})))) AS p FROM big),
slot AS (SELECT doc_id, item_id, shift, b.surface[p] AS i, d.surface[p + shift] AS v, count(*) AS n FROM pos JOIN b USING (item_id) JOIN d USING (doc_id) WHERE {_SQL_SLOT} GROUP BY ALL),
vals AS (SELECT doc_id, item_id, shift, i, max(n) AS agree, sum(n) AS n, coalesce(sum(n) FILTER (i <> v), 0) AS other FROM slot GROUP BY doc_id, item_id, shift, i),
tot AS (SELECT doc_id, item_id, shift, sum(agree) AS agree, sum(n) AS n, sum(other) AS other FROM vals GROUP BY doc_id, item_id, shift),
verb AS (SELECT doc_id, item_id, shift, len(list_filter(ats, lambda a: len(list_filter(generate_series(a, a + {WINDOW - 1}), lambda p: {_SQL_SLOT} AND b.surface[p] <> d.surface[p + shift])) = 0)) AS verbatim FROM big JOIN b USING (item_id) JOIN d USING (doc_id)),
good AS (SELECT big.*, CASE WHEN coalesce(other, 0) = 0 THEN 'exact' ELSE 'reparameterised' END AS kind FROM big JOIN verb USING (doc_id, item_id, shift) LEFT JOIN tot USING (doc_id, item_id, shift)
  WHERE 100 * (coalesce(n, 0) - coalesce(agree, 0)) <= {EXCEPTIONS} * coalesce(n, 0) OR verbatim > {RUN - WINDOW}),
best AS (SELECT doc_id, item_id, kind, matched, of_, count(DISTINCT item_id) OVER (PARTITION BY doc_id) AS n_items, row_number() OVER (PARTITION BY doc_id ORDER BY matched DESC, item_id, shift) AS k FROM good)
SELECT documents.doc_id, best.doc_id IS NOT NULL AS contaminated, item_id, kind, coalesce(matched, 0)::BIGINT AS matched, coalesce(of_, 0)::BIGINT AS "of", coalesce(n_items, 0)::BIGINT AS n_items
FROM documents LEFT JOIN best ON best.doc_id = documents.doc_id AND k = 1
""".replace("count(DISTINCT item_id) OVER (PARTITION BY doc_id)", "(SELECT count(DISTINCT g.item_id) FROM good g WHERE g.doc_id = good.doc_id)")


@query("op9_decontamination", ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
