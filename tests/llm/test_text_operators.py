"""Substring removal, near-duplicates, byte BPE and decontamination against brute force on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm.edge import documents, empty, prose, rows

from strideframe.llm import bytebpe, decontaminate, minhash, substring
from strideframe.llm.textkit import words_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_words_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab cé\n\t\x0b\x1c ") for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(0, 5))]
        words = words_of(pa.array(texts, pa.string()))
        want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        flat = [w.encode() for row in want for w in row]
        assert words.counts.tolist() == [len(w) for w in want] and words.text_of(0, len(flat)) == flat
        assert len({*zip(flat, words.code.tolist())}) == len(set(flat)) == len(set(words.code.tolist()))
        keep = np.array([rng.random() < 0.6 for _ in flat], bool)
        left = iter(keep.tolist())
        assert words.joined(keep) == [b" ".join(w.encode() for w in row if next(left)) for row in want]


@pytest.mark.parametrize("group", [2000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP", group)
    got = substring.strip_repeats(documents(spark)).select("doc_id", "text", "_n_words", "_n_removed", "_kept").collect()
    want = sorted(((r[0], r[1], *b) for r, b in zip(rows(), substring.brute_force([r[1] for r in rows()]))), key=repr)
    assert sorted(((r[0], r[1], r[2], r[3], hashlib.sha256(r[4].encode()).hexdigest()) for r in got), key=repr) == want


def test_repeats_of_empty_and_of_constant_text(spark):
    assert substring.without_repeats(empty(spark)).count() == 0
    docs = documents(spark, [(1, "x " * 100, None, None, None), (2, "y " * 35, None, None, None), (3, "y " * 34, None, None, None)])
    out = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert out == {1: "", 2: "y " * 35, 3: "y " * 34}


@pytest.mark.parametrize("small,block", [(32, 400), (1, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    data = [r for r in rows() if r[0] is not None]
    for g in range(6):  # groups whose members are near the threshold
        base = prose(100 + g, 80).split()
        for k in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(80)] = f"w{rng.random()}"
            data.append((1000 + 20 * g + k, " ".join(words), None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, data)).collect()}
    assert got == minhash.brute_force([r[:2] for r in data])


def test_near_duplicates_keep_one_of_each(spark):
    out = minhash.one_of_each(documents(spark), 85).select("doc_id", "text").collect()
    ids = [r.doc_id for r in out]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and ids.count(4) == 1
    assert {5, 6, 7} <= set(ids) and 8 in ids and 9 not in ids
    assert [r.text for r in out if r.doc_id is None] == [prose(8, 60)]
    assert minhash.one_of_each(empty(spark)).count() == 0


def test_short_sets_collide_like_long_ones():
    rng = np.random.default_rng(3)
    same = total = 0
    for _ in range(200):
        code = rng.integers(0, 2**63, 8).astype(np.uint64)
        a, b = np.sort(code[:7]), np.sort(np.concatenate([code[:6], code[7:]]))
        regs = minhash.registers(np.concatenate([a, b]), np.array([0, 7, 14]))
        same += int((regs[0] == regs[1]).sum())
        total += regs.shape[1]
    assert abs(same / total - 6 / 8) < 0.02


def _reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_reference_encoder(spark):
    reference = _reference()
    got = bytebpe.round_trip(documents(spark), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for r in rows():
        text = r[1] or ""
        ids = [i for at in range(0, len(text), 100_000) for i in reference.encode_ordinary(text[at : at + 100_000])] if "word" * 9 not in text else None
        want.append((r[0], None if ids is None else hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    long = {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows() if len(r[1] or "") > 100_000}
    have = [(r.doc_id, None if r.decoded_sha256 in long else r.ids_sha256, r.decoded_sha256) for r in got]
    assert sorted(have, key=repr) == sorted(((i, None if d in long else h, d) for i, h, d in want), key=repr)
    assert bytebpe.round_trip(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_and_chunks_give_the_ids_of_the_whole(monkeypatch):
    reference = _reference()
    tokenizer, _ = bytebpe._loaded(bytebpe.model_json(RANKS, public_tokenizers.PATTERN))
    held, rng = bytebpe._Chunks(tokenizer), random.Random(3)
    monkeypatch.setattr(bytebpe, "PIECE", 20)
    pools = ["ab c", "the  \n\t\r\x0b\x0c\x1c\x85\xa0 \u200b", "éèüß漢字😀", "'s're'll dXYZ", "0123½Ⅷ²", "<|endoftext|>", "\x00ÿ", "., "]
    for _ in range(1500):
        pool = "".join(rng.sample(pools, rng.randint(1, 4)))
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 100)))
        ids = np.frombuffer(b"".join(held.codes([p])[0] for p in bytebpe._pieces(text)), np.int32).tolist()
        assert ids == reference.encode_ordinary(text), text


def test_offsets_name_split_characters(spark):
    docs = documents(spark, [(1, "a 漢字 😀!", None, None, None), (2, None, None, None, None)])
    got = {r.doc_id: r for r in bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True).collect()}
    r = got[1]
    assert len(r.ids) == len(r.first) == len(r["last"]) and min(r.first) == 0 and max(r["last"]) == len("a 漢字 😀!")
    assert r.first.count(5) + r.first.count(4) >= 2 and got[2].ids == []
    back = bytebpe.decode(docs.limit(0).select("doc_id").selectExpr("1L as doc_id", "array(1) as ids").union(spark.createDataFrame([(1, r.ids), (2, r.ids[:-2])], "doc_id long, ids array<int>")), RANKS, public_tokenizers.PATTERN)
    texts = {x.doc_id: x.text for x in back.collect()}
    assert texts[1] == "a 漢字 😀!" and texts[2].endswith("\ufffd")


ITEMS = [
    (1, "A farmer has 12 red apples and sells 5 apples to Mary for 3 kg of wheat before sunset on the hill."),
    (2, "Which of these rivers flows through seven countries before it reaches the cold northern sea?"),
    (3, "too short"),
    (4, None),
    (5, ""),
    (2, "Which of these rivers flows through seven countries before it reaches the cold northern sea?"),
]
LEAKS = [
    (1, "intro words. " + ITEMS[0][1] + " after words"),
    (2, "intro A farmer has 40 red apples and sells 8 apples to John for 6 miles of wheat before sunset on the hill. more"),
    (3, "intro A farmer has 40 red apples and sells 40 apples to John for 6 kg of wheat before sunset on the hill. more"),
    (4, "clean text about a farmer who has apples and some rivers that flow to the sea before sunset"),
    (5, "WHICH OF THESE RIVERS, flows through seven countries; before it reaches the cold northern sea"),
    (6, "it is said that these rivers flows through seven countries before it reaches the cold northern sea and more besides"),
    (7, None), (8, ""), (9, "too short"), (4, "clean text again"), (None, ITEMS[1][1]),
]


def test_leaks_exact_and_reparameterised(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, [(*r, None, None, None) for r in LEAKS])
    got = {(r.doc_id, r.contaminated, r.kind, r.item_id) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {
        (1, True, "exact", 1), (2, True, "reparameterised", 1), (3, True, "reparameterised", 1), (4, False, None, None), (5, True, "exact", 2), (6, True, "exact", 2),
        (7, False, None, None), (8, False, None, None), (9, False, None, None), (None, True, "exact", 2),
    }
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).select("doc_id").collect()) == [4, 4, 7, 8, 9]


SLOTS = [
    (1, "For the fair, 3 red pens and 5 blue pens cost 20 coins, so how much does each pupil pay for one of them?"),
    (2, "Tom Smith buys 7 loaves of bread and gives 2 loaves away. Tom keeps the rest for the week ahead."),
    (3, "each of 7 boats carries 7 crates of salted fish along the whole coast before the long winter storms close every harbour"),
    (4, "we count 8 cats and 8 dogs and 8 birds that share 8 bowls with the old keepers"),
]
REPHRASED = [
    (1, "For the fair, 4 red pens and 4 blue pens cost 30 coins, so how much does each pupil pay for one of them?"),
    (2, "Anna buys 9 loaves of bread and gives 4 loaves away. Anna keeps the rest for the week ahead."),
    (3, "each of 7 boats carries 9 crates of salted fish along the whole coast before the long winter storms close every harbour"),
    (4, "we count 3 cats and 5 dogs and 9 birds that share 2 bowls with the old keepers"),
    (5, "\u201cAnna Maria Jones buys 9 loaves of bread and gives 4 loaves away. Anna keeps the rest for the week ahead.\u201d"),
]


def test_slots_that_coincide_names_anywhere_and_single_edits(spark):
    """Equal new values, renamed people at the start of a sentence, and one edited number are leaks; values that change at every place are not."""
    docs = documents(spark, [(*r, None, None, None) for r in REPHRASED])
    got = {r.doc_id: (r.kind, r.item_id) for r in decontaminate.decontaminate(docs, spark.createDataFrame(SLOTS, "item_id long, text string")).collect()}
    changed = "reparameterised"
    assert got == {1: (changed, 1), 2: (changed, 2), 3: (changed, 3), 4: (None, None), 5: (changed, 2)}


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, [(*r, None, None, None) for r in LEAKS])
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    plan = decontaminate.decontaminate(docs, bench)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_columns_named_like_the_scratch_columns(spark):
    """Extra columns may have any name, and repeated rows stay out of their way."""
    from pyspark.sql import functions as F

    from strideframe.llm import toxicity

    names = ("_id", "_hash", "_spots", "_kept", "_n_words", "_n_removed", "_toxicity", "_KEPT_")
    docs = documents(spark).withColumns({c: F.lit("mine") for c in names})
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("one", prose(2, 40)), (None, "x")], "item_id string, text string")
    for out in (minhash.one_of_each(docs), substring.without_repeats(docs), toxicity.without_toxic(docs, labels), decontaminate.without_leaks(docs, bench)):
        found = out.collect()
        assert out.columns == docs.columns and found and all(r[c] == "mine" for r in found for c in names)
    assert decontaminate.decontaminate(docs, bench).where("item_id = 'one'").count() > 0
