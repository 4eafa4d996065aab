"""Toxicity, licences, quality, vectors, URL rules and WARC derivatives."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from llm.edge import documents, empty, prose, rows
from pyspark.sql import functions as F

from strideframe.llm import licences, near_vectors, quality, toxicity, urls, warc

BAD = ["idiot", "worthless", "pathetic"]


def _labelled(n: int = 400):
    rng, docs, labels = random.Random(2), [], []
    for i in range(n):
        text, toxic = prose(500 + i, 40), i % 4 == 0
        if toxic:
            word = rng.choice(BAD)
            word = rng.choice([word, word.replace("i", "1").replace("o", "0"), "-".join(word), " ".join(word), word[0] + word[1] * 4 + word[2:], word.upper()])
            text = f"{text} {word} {prose(900 + i, 20)}"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not toxic), int(toxic)))
    return docs, labels


def test_toxicity_reads_through_obfuscation(spark):
    docs, labels = _labelled()
    extra = [(10_000 + i, r[1], None, None, None) for i, r in enumerate(rows())]
    out = {r.doc_id: r for r in toxicity.toxicity(documents(spark, docs + extra + [(None, "idiot", None, None, None)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in docs) and out[None].held_out is False
    held = [(out[i].predicted, t) for i, _, t in labels if out[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.9 and not any(p and not t for p, t in held)
    assert not any(out[10_000 + i].predicted for i in range(len(rows()))) and all(0 <= r.score <= 1 for r in out.values())
    assert out[10_004].score == out[10_005].score


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(documents(spark), none).collect()} == {0.5}
    assert toxicity.toxicity(empty(spark), none).count() == 0
    scored = toxicity.without_toxic(documents(spark), spark.createDataFrame([(1, 1, 0), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert scored.columns == documents(spark).columns and scored.count() == len(rows())


def test_viterbi_equals_all_readings():
    rng = np.random.default_rng(1)
    model = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE)))

    def every(columns):
        best = (-1e300, "")

        def walk(k, a, b, score, text):
            nonlocal best
            if k == len(columns) + 1:
                best = max(best, (score, text))
                return
            for piece, cost in (columns[k] if k < len(columns) else [(" ", 0.0)]):
                x, y, s = a, b, score + cost
                for c in piece:
                    z = toxicity._INDEX.get(c, toxicity.OTHER if c.isalpha() else 0)
                    if not (z == 0 and y == 0):
                        s, x, y = s + model[x, y, z], y, z
                walk(k + 1, x, y, s, text + piece)

        walk(0, 0, 0, 0.0, "")
        return best[1].strip()

    for token in ("1d10t", "a-b.c", "ssso", "l0$er"):
        columns = toxicity.lattice(token)
        assert toxicity.viterbi(columns, model) == every(columns)


def test_plain_letters_skip_the_lattice_and_flat_models_agree(monkeypatch):
    """Tokens of letters without a doubled one are read as they are; a model as a flat list reads a lattice as the array does."""
    rng = np.random.default_rng(2)
    model = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))).astype(np.float32)
    for token in ("1d10t", "a-b.c", "ssso", "l0$er", "stuupid"):
        columns = toxicity.lattice(token, stretched=True)
        assert toxicity.viterbi(columns, model.ravel().tolist()) == toxicity.viterbi(columns, model)
    restorer, index = toxicity.Restorer(model), {"word": 0, "wo": 1, "wordi*": 2, "ßtraß*": 3, "wordin*": 4}
    monkeypatch.setattr(toxicity, "bare", None)  # not reached
    assert toxicity._hits(restorer, index, {}, ["(word), wo wordings ßtraßen", None, "x"]) == [[0, 1, 2, 3, 4], [], []]


def test_licence_lines(spark):
    texts = [f"{prose(1, 30)}\nReleased under the MIT License.\n{prose(2, 20)}", "Licensed under CC BY-NC 4.0.", prose(3, 200), None, "", "This work is licensed under the Foo Bar Baz Public Terms, version 9.", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", prose(4, 30_000)]
    out = {r.doc_id: r for r in licences.licence_notices(documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert [out[i].families for i in range(8)] == [["mit"], ["cc-by-nc"], [], [], [], [], ["apache-2.0", "mit"], []]
    assert out[0].notices[0].paragraph == 1 and out[3].n_paragraphs == 0 and out[5].n_unknown <= 1
    assert licences.licence_notices(empty(spark)).count() == 0


def test_licences_of_other_families_are_unknown(spark):
    foreign = [
        "This software is licensed under the Foo Bar Public Licence, version 2; see the file LICENCE for the full terms.", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Eclipse Public License 2.0.",
        "Permission is granted to copy and redistribute this file without restriction provided this notice is preserved.",
    ]
    texts = [*foreign, *(prose(i, 30) for i in range(200)), *(prose(i, 2) for i in range(50))]
    out = {r.doc_id: r for r in licences.licence_notices(documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert all(not r.families for r in out.values())
    assert sum(out[i].n_unknown for i in range(4)) >= 3 and sum(r.n_unknown for i, r in out.items() if i > 3) <= 2


def test_quality_separates_and_exchanges(spark):
    data, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        text = prose(i, 60) if good else " ".join(w.upper() + "!!" for w in prose(i, 60).split())
        data.append((i, text, "en" if good or i % 2 else "de", f"s{i % 5}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(5, None, 0), (None, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.quality(documents(spark, data), frame).collect()}
    held = [(r.keep, i % 3 != 0) for i, r in out.items() if r.held_out]
    assert len(held) > 30 and all(a == b for a, b in held)
    assert quality.quality(documents(spark), frame.limit(0)).count() == len(rows()) and quality.quality(empty(spark), frame).count() == 0


def test_co_training_hands_over_labels():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200).astype(float)
    views = [y[:, None] * 3 + rng.normal(size=(200, 2)) for _ in range(2)]
    truth = rng.integers(0, 2, 1000).astype(float)
    pool = [truth[:, None] * 3 + rng.normal(size=(1000, 2)) for _ in range(2)]
    parts = lambda: ((np.arange(i, i + 250), [p[i : i + 250] for p in pool]) for i in range(0, 1000, 250))
    model = quality.CoTrained(views, y, lambda judges, taken: quality.surest(judges, taken, parts()))
    assert min(model.exchanged) > 100
    assert ((model.scores(pool)[:, 0] >= 0.5) == truth).mean() > 0.97


def _vectors(double: bool):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24))
    x[100:160] = x[0] + rng.normal(size=(60, 24)) * 0.18
    x[160:200] = x[1] + rng.normal(size=(40, 24)) * 0.3
    x[200:210] = x[2]
    x[210] = 3 * x[3]
    x = x if double else x.astype(np.float32)
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return data + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] + [1.0] * 23), (5, data[5][1]), (None, data[6][1])]


@pytest.mark.parametrize("double,tile", [(False, 1024), (True, 16)])
def test_vectors_equal_brute_force(spark, monkeypatch, double, tile):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    data = _vectors(double)
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{'double' if double else 'float'}>").withColumns({c: F.lit(1) for c in ("cell", "cid", "raw", "salt", "role", "many", "links")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()), key=repr)
    cast = float if double else np.float32

    def unit(v):
        if not v or any(c is None for c in v):
            return None
        x = np.array(v, cast).astype(float)
        return x / np.sqrt((x * x).sum()) if np.isfinite(x).all() and (x * x).sum() > 0 else None

    units, want, up = [unit(v) for _, v in data], [], list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(data)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and (a * b).sum() >= 0.95:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    for i, (ident, _) in enumerate(data):
        ids = [data[k][0] for k in range(len(data)) if root(k) == root(i) and data[k][0] is not None]
        least = min(ids, default=None)
        want.append((ident, n[i], least, ident is not None and ident == least))
    assert got == sorted(want, key=repr)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_rotation_keeps_distances_and_rows():
    x = np.random.default_rng(1).normal(size=(50, 24))
    y = near_vectors.rotated(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and (near_vectors.rotated(x[7:9]) == y[7:9]).all()


PAGES = [
    (1, "http://A.Example.NET/en/x?y"), (2, "https://example.net/de/1"), (3, "ftp://notexample.com/de/"), (4, "https://www.example.com/de/#a"), (5, "https://w.org/fr/?a=://b.net/"),
    (6, "no scheme"), (7, None), (8, ""), (9, "http://x.net"), (10, "http://x.net?q"), (11, "://net/"), (12, "http://x.net:80/"), (13, "a\n://ÄB.org/fr/é"), (14, "https://example.com/de"), (2, "https://example.net/de/1"), (None, "http://y.org/fr/z"),
]


def test_url_rules(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, urls.RULES).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/de/1", "net/", "block"), 3: ("notexample.com", "/de/", None, "allow"), 4: ("www.example.com", "/de/", "example.com/de/", "block"),
        5: ("w.org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("x.net", "", None, "allow"), 10: ("x.net", "", None, "allow"),
        11: ("net", "/", "net/", "block"), 12: ("x.net:80", "/", None, "allow"), 13: ("Äb.org", "/fr/é", "org/fr/", "allow"), 14: ("example.com", "/de", None, "allow"), None: ("y.org", "/fr/z", "org/fr/", "allow"),
    }
    assert urls.judge_urls(df.limit(0), urls.RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, [], default="block").collect()} == {"block"}


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: len(s))
    urls.DigestIndex.save([("block", "aa.com/"), ("allow", "bb.com/"), ("block", "bb.com/x")], str(tmp_path / "i"))
    index = urls.DigestIndex(str(tmp_path / "i"))
    assert index.judge(["aa.com", "www.bb.com", "cc.com", "bb.com"], ["/", "/", "/", "/xy"]) == [("aa.com/", True), ("bb.com/", False), (None, False), ("bb.com/x", True)]


def test_warc_derivatives_link_and_round_trip(spark, tmp_path):
    html = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B\n&#233;</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One&nbsp;two<br>three &#x41;&#66; &lt;b&gt; &#99999999; &amp;lt;</p><a href="/x">l</a></body></html>'
    pages = spark.createDataFrame([(1, "http://x/", html), (2, None, None), (3, "u", ""), (1, "http://x/", html)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "block", "title", "header")})
    source = warc.responses(pages)
    out = warc.derivatives(source)
    got = out.collect()
    assert len(got) == 8
    by = {(r.source_id, r.warc_type): r for r in got}
    text = by[1, "conversion"]
    assert text.block == "One two\nthree AB <b> &#99999999; &lt;\nl" and text.content_length == len(text.block)
    assert text.refers_to == by[1, "metadata"].refers_to != text.record_id and "title: A & B é\r\nlanguage: fr\r\nlinks: 1\r\n" in by[1, "metadata"].block
    assert by[2, "conversion"].block == "" and by[2, "conversion"].target_uri == ""
    assert f"WARC-Refers-To: {text.refers_to}\r\n" in text.header and f"WARC-Source-Payload-Digest: {text.payload_digest}" in text.header
    warc.write_warc(warc.response_records(source).unionByName(out.select("header", "block")), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert back.count() == 12 and back.where("not intact").count() == 0
    assert {r.header for r in back.where("header like '%conversion%'").collect()} == {r.header for r in got if r.warc_type == "conversion"}
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def _english():
    """A trigram model of a few plain sentences, as one task counts it."""
    import pyarrow as pa

    text = " ".join(["you are a stupid worthless idiot now and they will go home in the morning", "it is still a good book about the little old school on the hill", "an idiot said so", "keep the dog away from the kid and hug the cat"] * 50)
    n3 = np.zeros(toxicity.SIZE**3)
    for part in toxicity._count_trigrams(iter([pa.RecordBatch.from_pydict({"text": [text]})])):
        known = part.filter(part.column("trigram").is_valid())
        n3[known.column("trigram").to_numpy()] += known.column("n").to_numpy()
    n3 = n3.reshape((toxicity.SIZE,) * 3)
    return np.log((n3 + 0.01) / (n3 + 0.01).sum(2, keepdims=True))


@pytest.mark.parametrize("between", [" ", ".", "-"])
def test_long_spaced_runs_are_decoded(between):
    restorer, plain = toxicity.Restorer(_english()), "youareastupidworthlessidiotnow"
    for times in (1, 3, 2000):
        words = restorer.words(between.join(plain * times))
        assert {"stupid", "worthless", "idiot"} <= words
    assert {"stupid", "worthless"} <= restorer.words("y0u.are.a.stup1d.w0rthless.id1ot." * 20)


@pytest.mark.parametrize(("token", "word"), [("i_d_i_o_t", "idiot"), ("stu_pid", "stupid"), ("iiddiioott", "idiot"), ("stuupid", "stupid"), ("d o g", "dog"), ("k.i.d", "kid"), ("hug, h-u-g", "hug"), ("id\u200biot", "idiot"), ("stu\u00adpid", "stupid"), ("іdіоt", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("ĭdĩōt", "idiot"), ("st|_|pid", "stupid"), ("h()me", "home"), ("vvill", "will"), ("5+1!|", "still")])
def test_each_form_of_the_lattice_is_decoded(token, word):
    assert word in toxicity.Restorer(_english()).words(f"now {token} now")


def test_other_scripts_and_numbers_stay():
    restorer = toxicity.Restorer(_english())
    assert restorer.words("жизнь 455 2024 été 漢字 λόγος") == {"жизнь", "été", "漢字", "λόγος"}


def test_common_doubled_words_stay(spark):
    model, common = toxicity.trigram_model(documents(spark, [(i, "a vacuum, a book and a Vacuum!" if i < 5 else "iiddiioott", None, None, None) for i in range(6)]))
    assert common == {"vacuum", "book"} and toxicity.Restorer(model, 0, common).words("vacuum") == {"vacuum"}


def test_wrapped_and_embedded_licence_notices(spark):
    import textwrap

    def wrapped(family, which, mark=""):
        return "\n".join(mark + x for x in textwrap.wrap(licences.TEMPLATES[family][which], 60))

    cases = [("gpl-2.0", wrapped("gpl-2.0", 1, "# ")), ("gpl-3.0", wrapped("gpl-3.0", 1, " * ")), ("isc", wrapped("isc", 0)), ("bsd", wrapped("bsd", 1, "// ")), ("mit", licences.TEMPLATES["mit"][1])]
    texts = [f"{prose(i, 20)}\n{t}\n{prose(50 + i, 20)}" for i, (_, t) in enumerate(cases)]
    texts += [f"{prose(90 + i, 3000)} {' '.join(t.split())} {prose(150 + i, 3000)}" for i, (_, t) in enumerate(cases)]
    out = {r.doc_id: r for r in licences.licence_notices(documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert [out[i].families for i in range(len(texts))] == [[f] for f, _ in cases] * 2
    assert all(out[i].notices[0].paragraph == 1 and out[i].n_unknown == 0 for i in range(len(cases)))
