"""Toxicity of whole texts after noisy-channel deobfuscation.

* **Language model.** Character trigrams of all documents, counted inside the tasks and summed by a
  group-by; the table is bounded by the alphabet (letters up to U+00FF, one class for all others, one boundary).
* **Channel.** A token with look-alike signs between letters, three equal letters in a row, letters that are
  parted by blanks, signs or underscores (three letters or more), or a doubled letter in a word that is rare in the
  corpus is a lattice: each sign may stand for some letters, for nothing or for a word end, each
  run for one or two letters.  So are tokens with letters of other alphabets that look Latin, with Latin letters beyond
  U+00FF (wide, styled or accented: their base letter), with several signs that draw one letter, and tokens of look-alike signs alone unless all are
  digits.  Invisible signs are removed; accents up to U+00FF are spelling and stay.  Viterbi decoding under the model picks the
  reading.  Other tokens have one reading, themselves in lower case.  A word is rare below ``LEAST_COUNT`` occurrences or a share of ``1 / COMMON`` of
  all words with a doubled letter, so at most ``COMMON`` words count as common.
* **Classifier.** Features are the restored words and their prefixes of 4 to 6 letters.  Document
  frequencies by label over distinct labelled texts give the candidates (log odds at least ``LEAST_Z`` standard
  errors); a logistic regression with an L2 penalty weighs them.  It is fitted on at most ``SAMPLE`` labelled
  rows, chosen by a hash of the id; the language model and the scoring cover all rows.

Labels, lang, source and doc_id are no features.  Defined cases: null and empty texts score by the intercept;
rows with crc32(doc_id) mod 5 = 0 are held out and never fitted on; a null id is not held out; null labels
are not fitted on; without labelled rows of both classes all texts score as the (smoothed) share of toxic ones; repeated rows
are scored alike and count once in the fit; spaced runs and tokens of any length are decoded in one pass, those over
``LONGEST`` characters are not remembered.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.llm.registry import query, table
from strideframe.llm.scratch import free_name, run_folder, settled
from strideframe.llm.textkit import slices

SAMPLE, LEAST_Z, LEAST_ODDS, FEATURES, LONGEST, CACHE = 20_000, 3.0, 1.5, 4096, 64, 200_000
COMMON, LEAST_COUNT = 50_000, 3
Batches = Iterator[pa.RecordBatch]
# The letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
# Cyrillic and Greek letters that look Latin, and signs that draw a letter together.
ALPHABETS = {"а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
DRAWN = {"|_|": "u", "\\/\\/": "w", "\\/": "v", "/\\": "a", "|-|": "h", "|<": "k", "|)": "d", "()": "o", "[]": "o"}
SEPARATORS = "-_.,/~'`^:;"
WILD = "*#%&?"

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(i) for i in range(0xDF, 0x100) if chr(i).isalpha())
_INDEX = {c: i + 1 for i, c in enumerate(_LETTERS)}
OTHER, SIZE = len(_LETTERS) + 1, len(_LETTERS) + 2
_TABLE = np.zeros(257, np.int64)
for _c, _i in _INDEX.items():
    _TABLE[ord(_c)] = _i
_TABLE[256] = OTHER


def _count_trigrams(batches: Batches) -> Batches:
    """Trigram numbers with their counts, and words with a doubled letter with theirs."""
    total, words = np.zeros(SIZE**3, np.int64), Counter()

    def counted():
        return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["trigram", "word", "n"])

    for batch in (part for whole in batches for part in slices(whole, "text")):
        text = "\n\n".join(["", *[t for t in batch.column("text").to_pylist() if t], ""]).lower()
        code = _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 256)]
        total += np.bincount((code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:], minlength=SIZE**3)
        for token, n in Counter(text.split()).items():
            if _TWICE.search(token) and (core := bare(token)).isalpha() and len(core) <= LONGEST and not _THRICE.search(core):
                words[core] += n
        if len(words) > CACHE:
            yield counted()
            words.clear()
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.string()), pa.array(total[some])], ["trigram", "word", "n"])
    yield counted()


def trigram_model(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, frozenset[str]]:
    """log P(c | a, b) over all documents, interpolated with shorter contexts, and the common words with a doubled letter."""
    counts = docs.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(_count_trigrams, "trigram long, word string, n long").groupBy("trigram", "word").agg(F.sum("n").alias("n"))
    counts = settled(counts, run_folder(docs.sparkSession), "counts")
    doubled = counts.where("word is not null")
    least = max(LEAST_COUNT, (doubled.agg(F.sum("n")).first()[0] or 0) / COMMON)
    common = frozenset(r.word for r in doubled.where(F.col("n") >= least).select("word").collect())
    rows = counts.where("word is null").select("trigram", "n").toPandas()
    n3 = np.zeros(SIZE**3)
    n3[rows["trigram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    n3 = n3.reshape(SIZE, SIZE, SIZE)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1 + 1).sum()
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    return np.log((n3 + 5 * p2[None]) / (n3.sum(2, keepdims=True) + 5)).astype(np.float32), common


_SUSPECT = re.compile(r"(.)\1\1|\w[^\w\s]+\w|[^\W_]_+[^\W_]")
_LETTERS_ONLY = re.compile(r"[^\W\d_]+")
_TWICE, _THRICE = re.compile(r"([^\W\d_])\1"), re.compile(r"(.)\1\1")
_SIGN, _LETTER = re.compile(r"[0-9@$!|+(€£]"), re.compile(r"[^\W\d_]")
_EDGES = "\"'()[]{}<>«»“”„.,;:?…"
_JUNK = re.compile(r"([^\w\s])\1+$")
_SPACED = re.compile(r"(?<![\w@$])[\w@$](?:[ .\-_*/]{1,2}[\w@$]){2,}(?![\w@$])")


_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
#: One private sign stands for each drawing, so that it is one column of the lattice.
_MARK = {drawing: chr(0xE000 + i) for i, drawing in enumerate(DRAWN)}
_LETTER_OF = {_MARK[drawing]: letter for drawing, letter in DRAWN.items()}
_DRAWN = re.compile("|".join(map(re.escape, DRAWN)))
_RUN, _REPEATED = re.compile(r"(.)\1*"), re.compile(r"(.)\1|\n")


@lru_cache(CACHE)
def latin(c: str) -> str:
    """The Latin letter that a letter beyond U+00FF looks like, else nothing."""
    base = unicodedata.normalize("NFKD", c)[:1].lower()
    return base if base.isascii() and base.isalpha() else ALPHABETS.get(c, "")


def bare(token: str) -> str:
    """The token without signs at its ends."""
    core = token.strip(_EDGES)
    return core if core.isalnum() else _JUNK.sub("", core).strip(_EDGES)


@lru_cache(CACHE)
def _readings(c: str, n: int) -> list[tuple[str, float]]:
    """The readings of one character that stands ``n`` times, three for more."""
    if c in LOOKALIKES:
        options = [(x, -0.5) for x in LOOKALIKES[c]] + [(" ", -9.0)] + ([("", -3.0)] if not c.isdigit() else [])
        options += [(x + x, -1.0) for x in LOOKALIKES[c]] * (n > 1)
    elif c in WILD:
        options = [("", -4.0), (" ", -3.0)] + [(x, -3.0) for x in _LETTERS[:26]] * (n == 1)
    elif c in _LETTER_OF:
        options = [(_LETTER_OF[c], -0.3), (" ", -4.0)]
    elif c > "ÿ" and latin(c):
        options = [(latin(c) * min(n, 2), -0.2), (c * min(n, 2), -3.0)] + [(latin(c), -0.7)] * (n > 1)
    elif c.isalpha():
        options = [(c, 0.0)] if n == 1 else [(c + c, -0.1), (c, -6.0)] if n == 2 else [(c, -0.7), (c + c, -0.7)]
        options = options + [("w", -1.0)] * (c == "v" and n > 1)
    elif c in SEPARATORS or c.isspace():
        options = [(" ", -0.7), ("", -1.4)]
    else:
        options = [(" ", 0.0)]
    return options


def lattice(token: str, stretched: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of equal characters its readings and their log probabilities in the channel; in a stretched token two are like more."""
    if not _REPEATED.search(token):
        return [_readings(c, 1) for c in token]
    return [_readings(m.group(1), 3 if stretched and m.group(1).isalpha() and m.end() - m.start() == 2 else min(m.end() - m.start(), 3)) for m in _RUN.finditer(token)]


@lru_cache(CACHE)
def _codes(piece: str) -> tuple[int, ...]:
    """The numbers of the characters of a reading in the trigram table."""
    return tuple(_INDEX.get(c, OTHER if c.isalpha() else 0) for c in piece)


def viterbi(columns: list[list[tuple[str, float]]], model: np.ndarray | list[float]) -> str:
    """The likeliest reading of a lattice between two word boundaries; a flat list as ``model`` is looked up faster than an array."""
    flat = model if isinstance(model, list) else model.ravel().tolist()
    # a state is the pair of the last two characters, as one number
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in [*columns, [(" ", 0.0)]]:
        if len(states) == 1 and len(options) == 1:  # one way on: nothing to choose
            ((pair, (score, path)),) = states.items()
            ((piece, cost),) = options
            y, s = pair % SIZE, score + cost
            for z in _codes(piece):
                if z or y:
                    s += flat[pair * SIZE + z]
                    pair, y = y * SIZE + z, z
            states = {pair: (s, (path, piece) if piece else path)}
            continue
        ahead: dict[int, tuple[float, tuple | None]] = {}
        coded = [(piece, cost, _codes(piece)) for piece, cost in options]
        for pair, (score, path) in states.items():
            for piece, cost, codes in coded:
                k, y, s = pair, pair % SIZE, score + cost
                for z in codes:
                    if z or y:
                        s += flat[k * SIZE + z]
                        k, y = y * SIZE + z, z
                held = ahead.get(k)
                if held is None or s > held[0]:
                    ahead[k] = (s, (path, piece) if piece else path)
        states = ahead
    # shared path cells keep time and memory linear in the length
    pieces, path = [], max(states.values(), key=lambda v: v[0])[1]
    while path:
        path, piece = path
        pieces.append(piece)
    return "".join(reversed(pieces)).strip()


class Restorer(dict):
    """raw token -> restored words; remembers up to ``most`` tokens."""

    def __init__(self, model: np.ndarray, most: int = 0, common: frozenset[str] = frozenset()):
        self.model, self.most, self.common = model.ravel().tolist(), most, common

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = self.read(token)
        if len(self) > self.most:
            self.clear()
        if self.most and len(token) <= LONGEST:
            self[token] = words
        return words

    def read(self, token: str) -> tuple[str, ...]:
        """The restored words of a token."""
        core = token if token.isalpha() else token.strip(_EDGES)
        if core.isalpha() and (core.isascii() or max(core) <= "ÿ") and "()" not in token and "[]" not in token:  # most tokens: letters between quotes and stops
            return (core,) if not _TWICE.search(core) or core in self.common else tuple(viterbi(lattice(core, stretched=True), self.model).split())
        drawn = _DRAWN.sub(lambda m: _MARK[m.group()], token) if _DRAWN.search(token) and _LETTER.search(token) else token
        core = bare(drawn)
        foreign = [c for c in core if c > "ÿ" and c.isalpha()] if not core.isascii() else []
        if drawn != token or (foreign and all(map(latin, foreign))) or (len(core) > 2 and not core.isdigit() and all(c in LOOKALIKES for c in core)):
            return tuple(viterbi(lattice(core), self.model).split())
        if core.isalpha():
            return (core,) if core in self.common or not _TWICE.search(core) else tuple(viterbi(lattice(core, stretched=True), self.model).split())
        if " " in core or _SUSPECT.search(core) or (_SIGN.search(core) and _LETTER.search(core)):
            return tuple(viterbi(lattice(core), self.model).split())
        return tuple(_LETTERS_ONLY.findall(core))

    def tokens(self, text: str | None) -> set[str]:
        """The distinct raw tokens of a text in lower case; letters that stand apart are one token."""
        if not text:
            return set()
        low = text.lower() if text.isascii() else _INVISIBLE.sub("", text.lower())
        return {*low.split(), *(m.group().strip() for m in _SPACED.finditer(low))}

    def words(self, text: str | None) -> set[str]:
        return {w for t in self.tokens(text) for w in self[t]}


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def _gather(model):
    def run(batches: Batches) -> Batches:
        restorer, n, toxic = Restorer(model.value[0], CACHE, model.value[1]), Counter(), Counter()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = {f for w in restorer.words(text) for f in features(w)}
                n.update(found)
                if label:
                    toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[f] for f in n], pa.int64())], ["feature", "n", "toxic"])

    return run


def _hits(restorer: Restorer, index: dict[str, int], known: dict[str, tuple], texts: list[str | None]) -> list[list[int]]:
    """The indexes of the features in each text."""
    starts = {f[:4] for f in index}
    stems = [(k, {f[:k]: i for f, i in index.items() if len(f) == k + 1 and f[k] == "*"}) for k in (4, 5, 6)]  # as `features` writes them
    rows = []
    for text in texts:
        tokens, found = restorer.tokens(text), set()
        for t in tokens.difference(known):
            ids = []
            for w in restorer.read(t):
                if w[:4] not in starts:
                    continue
                if w in index:
                    ids.append(index[w])
                ids += [held[w[:k]] for k, held in stems if len(w) > k and w[:k] in held]
            if len(t) <= LONGEST:
                known[t] = tuple(ids)
            elif ids:
                found.update(ids)
        found.update(chain.from_iterable(filter(None, map(known.get, tokens))))
        rows.append(sorted(found))
        if len(known) > CACHE:
            known.clear()
    return rows


def _matrix(model, wanted):
    def run(batches: Batches) -> Batches:
        restorer, known = Restorer(model.value[0], 0, model.value[1]), {}
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = _hits(restorer, wanted.value, known, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "hits"])

    return run


def fit_logistic(rows: list[list[int]], labels: np.ndarray, size: int, penalty: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of sparse 0/1 features, by accelerated gradient steps on the mean loss."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.array([i for r in rows for i in r], np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    w, b = np.zeros(size), math.log(share / (1 - share))
    if not len(flat):
        return w, b
    most = np.bincount(owner).max() + 1
    step, vw, vb = 4 * len(rows) / (len(rows) * most + 4 * penalty), w.copy(), b
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(vb + np.bincount(owner, weights=vw[flat], minlength=len(rows)))))
        error = (p - labels) / len(rows)
        nw = vw - step * (np.bincount(flat, weights=error[owner], minlength=size) + penalty * vw / len(rows))
        nb = vb - step * error.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def held_out(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Scorer:
    """A fitted model: the trigrams with the common doubled words, the features with their weights, and the intercept."""

    def __init__(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"):
        spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
        source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        self.model = spark.sparkContext.broadcast(trigram_model(source))
        known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        share = SAMPLE / max(1, known.count())
        sample = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < int(share * 2**63)) if share < 1 else known
        # about SAMPLE narrow rows, whatever the size of the tables
        fitted = source.join(F.broadcast(sample), "doc_id").where("text is not null").groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic")
        fitted = settled(fitted, folder, "fitted")
        total, toxic = fitted.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        n, t = F.col("n"), F.col("toxic")
        odds = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((n - t + 0.5) / (total - toxic - n + t + 0.5))
        error = F.sqrt(1 / (t + 0.5) + 1 / (toxic - t + 0.5) + 1 / (n - t + 0.5) + 1 / (total - toxic - n + t + 0.5))
        counts = fitted.mapInArrow(_gather(self.model), "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        chosen = counts.select("feature", odds.alias("odds"), (odds / error).alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "feature").limit(FEATURES).toPandas()
        index = {f: i for i, f in enumerate(chosen["feature"])}
        matrix = fitted.mapInArrow(_matrix(self.model, spark.sparkContext.broadcast(index)), "toxic int, hits array<int>").toPandas()
        weights, intercept = np.zeros(len(index)), 0.0
        if len(matrix):
            weights, intercept = fit_logistic([list(h) for h in matrix["hits"]], matrix["toxic"].to_numpy(float), len(index))
        self.fitted = spark.sparkContext.broadcast((index, weights, intercept))

    def add(self, docs: DataFrame, column: str, text: str = "text") -> DataFrame:
        """All rows and columns of ``docs``, with the score as ``column``."""
        model, fitted = self.model, self.fitted

        def run(batches: Batches) -> Batches:
            index, weights, intercept = fitted.value
            restorer, known = Restorer(model.value[0], 0, model.value[1]), {}
            for batch in (part for whole in batches for part in slices(whole, text)):
                rows = _hits(restorer, index, known, batch.column(text).to_pylist())
                raw = np.array([intercept + weights[r].sum() if r else intercept for r in rows], float)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-raw)))], [*batch.schema.names, column])

        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scorer = Scorer(docs, labels, doc_id, text, label)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return scorer.add(source, "score").select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half, with all their columns."""
    score = free_name(docs, "_toxicity")
    return Scorer(docs, labels).add(docs, score).where(F.col(score) < 0.5).drop(score)


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, by the labels that are not held out."""
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
