"""Main text, whitening and ranked search against brute force and planted cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.edge import documents, empty, prose, rows
from pyspark.sql import functions as F

from strideframe.llm import mainhtml, ranked, whitening

SHARE = '<div class="tools"><span>Print this page</span> <span>Send by mail</span></div>'


def _article(i: int, extra: str = "") -> str:
    return f"<article><h1>Title {i}</h1><p>{prose(i, 12)}<br>second &amp; last<p>{prose(100 + i, 8)}</p>{extra}</article>"


def _texts(spark, rows, **options):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumns({c: F.lit("clash") for c in ("host", "key", "keys", "text", "n_chars", "same")})
    out = mainhtml.main_texts(frame, **options)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    return {k: r.text for k, r in got.items()}


def _pages():
    out = []
    for i in range(8):  # a site whose articles all end with the same tools, and whose frame is a plain container
        out.append((i, f"http://A.example/{i}", f"<html><head><title>t</title></head><body><div><b>Site name</b></div>{_article(i, SHARE)}<footer>f</footer></body>"))
    for i in range(8, 12):  # no marked article: the frame recurs, the paragraphs do not
        out.append((i, f"http://b.example/{i}", f"<body><div><span>Welcome to b</span><ul><li>One<li>Two</ul></div><p>{prose(i, 20)}</p><p>{prose(200 + i, 5)}"))
    for i in range(12, 18):  # copies of one article, on one host
        out.append((i, f"http://c.example/{i}", f"<nav><a href=/>n{i}</a></nav><article><div>{prose(77, 30)}</div></article>"))
    return out


@pytest.mark.parametrize("most", [mainhtml.BROADCAST_TEMPLATES, 0])
def test_templates_of_a_site_go_and_articles_stay(spark, most):
    pages = _pages()
    got = _texts(spark, [*pages, pages[0]], most=most)
    for i in range(8):
        assert got[i] == f"Title {i}\n{prose(i, 12)} second & last\n{prose(100 + i, 8)}"
    for i in range(8, 12):
        assert got[i] == f"{prose(i, 20)}\n{prose(200 + i, 5)}"
    assert {got[i] for i in range(12, 18)} == {prose(77, 30)}
    # the counts alone tell: on a host with two pages the tools stay
    few = _texts(spark, pages[:2], most=most)
    assert few[0].endswith("Print this page Send by mail")


def test_template_counts_equal_brute_force(spark):
    pages = _pages()
    seen, articles = defaultdict(set), defaultdict(set)
    for _, url, html in pages:
        site = url.split("/")[2].lower()
        article, some = mainhtml.Page(html).candidates()
        articles[site].add(article)
        for _, digest, half in some:
            seen[site, digest, half].add(article)
    want = {mainhtml._key(site, d, half) for (site, d, half), a in seen.items() if len(a) >= mainhtml.MANY and (not half or 2 * len(a) >= len(articles[site]))}
    frame = spark.createDataFrame([(u.split("/")[2].lower(), h) for _, u, h in pages], "host string, html string")
    assert want and {r.key for r in mainhtml.templates(frame).collect()} == want


def test_page_forms(spark):
    cases = {
        "": "", "plain &lt;text&gt; &#233;&eacute;&amp; &amp &am": "plain <text> éé& & &am",
        "<p>a<p>b  \n c<div>d</div>e": "a\nb c\nd\ne", "<article>x<script>var t='</p>'</script>y<style>z</style></article>out": "xy",
        "<header>h</header><article><header><h1>H</h1></header>t<aside>s</aside><footer>f</footer></article>": "H\nt",
        "<article>t</article><section class='comments'><article>c</article></section>": "t",
        "<div id=cookie-banner>c</div><div class='ad'>a</div><div class=adAgency>x</div><div class=address>kept</div>": "kept",
        "<div class='wrap has-sidebar'><article class='post no-comments'>kept<div class=sidebar>s</div></article><div class=sidebar>out</div></div>": "kept",
        "<div class='related'><article>teaser</article></div><article class=ad>a</article><p>body": "body", "<main><p>m</p></main><p>o</p>": "m", "<p hidden>h</p><p style='display: none'>i</p><p aria-hidden=true>j</p><p>k</p>": "k",
        "<!-- c -- > still -->t": "t", "t<!-- open <p>x": "t", "</div></p>t<b>u": "tu", "<form><p>f</p></form><ul><li>1<li>2</ul><table><tr><td>3<td>4</table>": "1\n2\n3\n4",
        "a < b <c": "a < b <c", "<p title='a>b'>q</p><img alt='x'>": "q", "<a href='1'>l</a> m": "l m", "<article><p>one</article><article><p>two</article>": "one\ntwo",
        "x y": "x y", "<div>" * 3000 + "deep" + "</div>" * 10: "deep", "<article>" + "<p>w</p>" * 20_000 + "</article>": "\n".join(["w"] * 20_000), "<" * 50_000: "<" * 50_000, "<a '" * 3000: "<a '" * 3000,
    }
    got = _texts(spark, [*((i, None, h) for i, h in enumerate(cases)), (900, "no host", None), (None, None, "<p>null id")])
    assert {h: got[i] for i, h in enumerate(cases)} == cases and got[900] == "" and got[None] == "null id"
    assert _texts(spark, []) == {}


def _vectors(seed: int, n: int, d: int):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(1, 0.05, d) + rng.standard_normal(d)).astype(np.float32)


@pytest.mark.parametrize("n, d", [(400, 64), (300, 5), (40, 64), (2, 3)])
def test_whitening_equals_dense_algebra(spark, n, d):
    v = _vectors(n, n, d)
    data = [*((i, x.tolist()) for i, x in enumerate(v)), (n, v[0].tolist()), (None, v[0].tolist()), (n + 1, None), (n + 2, []), (n + 3, [None] * d), (n + 4, [float("nan")] * d), (n + 5, [1.0] * (d + 1)), (n + 6, [math.inf] * d)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3).withColumn("x", F.lit(1))
    got = whitening.whitened(frame).collect()
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    m, sums = len(fit), fit.sum(0)
    centred = (m * fit - sums) / m
    e, q = np.linalg.eigh(centred.T @ centred / m)
    e, q = e[::-1], q[:, ::-1]
    k = min(16, d, int((e > 1e-12 * e.sum()).sum()))
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert set(by) == {*range(n + 1), None} and all(sorted(c) == list(range(1, k + 1)) for c in by.values())
    assert len({r.n for r in got}) == 1 and got[0].n == m and all(r.identity_error < 1e-9 for r in got)
    exact = {i: sum((m * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums)) for i in range(n)}
    assert all(r.deviation == exact[r.vec_id if r.vec_id is not None and r.vec_id < n else 0] for r in got)
    want = ((m * x - sums) / m) @ q[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        mine = np.array([by[i][c + 1].whitened for i in range(n)])
        assert abs(by[0][c + 1].explained / (e[c] / e.sum()) - 1) < 1e-9
        assert min(np.abs(mine - want[:, c]).max(), np.abs(mine + want[:, c]).max()) < 1e-6


def test_whitening_finds_what_the_start_misses_and_defined_cases(spark):
    # one far eigenvalue among equal ones, and eigenvalues in clusters
    rng = np.random.default_rng(3)
    for e in (np.append(np.ones(99), 50.0), np.repeat([5.0, 4.0, 1.0, 0.0], 25), np.linspace(1.0, 1.05, 100)):
        q = np.linalg.qr(rng.standard_normal((100, 100)))[0]
        a = (q * e) @ q.T
        values, axes = whitening.leading(lambda b, a=a: a @ b, 100)
        assert np.allclose(values, np.sort(e)[::-1][:16], rtol=1e-9) and np.abs(a @ axes - axes * values).max() < 1e-8
    schema = "vec_id long, embedding array<double>"
    for data in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(spark.createDataFrame(data, schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [3.0])], schema)).count() == 2


def _brute(docs, items, k):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = lambda t: term.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    held = [(i, Counter(low(t)), len(low(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(h[2] for h in held)
    df = Counter(t for h in held for t in h[1])
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(low(t))
    out = []
    for item, ts in wanted.items():
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, vocabulary", [(4096, 500_000), (7, 40)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block, vocabulary):
    rng = random.Random(4)
    data = [(100 + i, " ".join(rng.choice("ab éé C d1 ef gh, ij".split()) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    data = [(r[0], r[1]) for r in rows()] + data + [(50 + i, "ab ef gh") for i in range(40)]
    items = [(1, "AB c éé"), (2, prose(1, 80)), (3, None), (4, "..."), (1, "d1"), (None, "one ef"), (5, "missing"), (6, prose(9, 300) + " ab"), (7, "x")]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).withColumns({c: F.lit(1) for c in ("n", "terms", "score", "item", "rank", "slice")})
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "VOCABULARY", vocabulary)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = ranked.ranked(frame, asked, 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(data, items, 20)


def test_ranked_search_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked.ranked(documents(spark), none).count() == 0 and ranked.ranked(empty(spark), one).count() == 0


def test_grouped_masks_of_several_words():
    rng = np.random.default_rng(5)
    masks = rng.integers(0, 3, (500, 3)).astype(np.uint64)
    distinct, group = ranked._grouped(masks)
    assert (distinct[group] == masks).all() and len(distinct) == len({tuple(r) for r in masks.tolist()})
