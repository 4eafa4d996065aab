"""Documents with every awkward case, and extra columns whose names the operators use inside."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta river stone cloud maple ember frost linen copper quiet marble velvet amber".split()
EXTRA = ("h_text", "band", "anchor", "place", "set_id", "n", "score", "spots", "words", "cid", "cell", "kept", "h", "mark", "w", "item_id", "y", "toxic", "ids")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def rows() -> list[tuple[int | None, str | None, str | None, str | None, int | None]]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(7, 50)
    long = prose(9, 40_000)
    texts = [base, base, " ".join(near), prose(2, 90), None, "", " \n\t ", "one", "One", "a b c", "A B C", "x " * 200, f"{prose(3, 40)} {passage} {prose(4, 30)}", f"{prose(5, 20)} {passage}", long, long[:150_000] + " end", "word" * 30_000, prose(6, 35), prose(6, 35) + "\u00a0tail", "ünï çödé 漢字 \u0085 \U0001f600"]
    out: list = [(i + 1, t, "en" if i % 3 else None, f"s{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, prose(8, 60), None, None, None), (None, base, None, None, None)]


def documents(spark, data=None):
    df = spark.createDataFrame(rows() if data is None else data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


def empty(spark):
    return documents(spark, [])
