"""Main text of web pages by the removal of site templates.

A page is read once into element subtrees.  Each subtree has a 64-bit digest of its tag, its text and its child
elements; Spark counts, per host, the distinct articles that a digest comes with.  A subtree is a template of the site, and is deleted,
if it comes with at least ``MANY`` articles of the host and

* stands outside the marked article (``article``, else ``main``), or consists of links only, or
* comes with at least half of the articles of the host; paragraphs and other text blocks inside a marked
  article are no candidates, since articles quote each other.

Pages with one content count once, so that copies of an article, however many, make it no template.
What the counts cannot see (a host with few pages) goes by its markup: elements that are navigation, asides, forms, footers,
page headers, scripts or hidden, or whose class, id or role says so, and all that stands outside the marked
article.  What is left is the text: character references decoded, white space inside a block made one
space, blocks joined by a line break in page order.  Line-break elements are white space.

Counts are two group-bys over slim rows; a host with a third of all pages is spread by (host, digest, article).  Templates up to
``BROADCAST_TEMPLATES`` are sent to the tasks as sorted digests; beyond that, pages are joined with the templates they hold.

Defined cases: a null page is empty; a page without a marked article gives what is left of its body; a page whose url
has no host belongs to no site, and only its markup counts; unclosed comments, scripts and elements
reach to the end of what holds them; stray end tags are ignored; nesting may have any depth; repeated rows give equal results and
count once; only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.registry import query, table
from strideframe.llm.scratch import run_folder, settled
from strideframe.llm.urls import host

MANY, BROADCAST_TEMPLATES, SLICE = 3, 2_000_000, 256
Batches = Iterator[pa.RecordBatch]

# Elements of HTML by the part that they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption caption article main body html".split())
DROPPED = frozenset("nav aside footer form dialog menu search button select option datalist fieldset label input textarea script style noscript template head title iframe noembed noframes xmp object embed canvas audio video svg math".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("html body article aside main nav section div ul ol dl table form header footer td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Whole class names and ids, and parts of them between signs, that mark what is no article.
NAMES = frozenset("header footer head foot nav menu topbar bottombar related recommended recommendations share sharing social notice notices notification notifications alert widget widgets tags reply replies respond discussion toolbar pagination pager search login signup popup modal overlay hidden".split())
STRONG = frozenset("comment comments commentlist comment-list reply replies respond disqus related recommended recommendations ad ads advert advertisement sponsored promo".split())
PARTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr newsletter subscribe subscription sidebar navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus masthead skyscraper paywall".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORTH = re.compile(r"class|id|role|hidden|style|aria", re.I)
_PIECES = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_SPACE = " \t\n\r\f"
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_MASK = (1 << 64) - 1


def _named(attributes: str) -> int:
    """Whether class, id, role or visibility say that an element is no part of an article: 2 whatever it holds, 1 unless it holds an article, else 0."""
    if not attributes or not _WORTH.search(attributes):
        return 0
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(next((v for v in values if v), ""))
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return 2
        if name == "role" and value.strip().lower() in ROLES:
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if name in ("class", "id"):
            for one in value.split():
                if one.lower() in STRONG:
                    return 2
                if one.lower() in NAMES or any(p.lower() in PARTS for p in _PIECES.findall(one)):
                    found = 1  # layouts are named like that, too: "has-sidebar"
    return found


class Page:
    """The elements of a page in page order (parents before children), and its text blocks.

    For each element: tag, parent, whether markup drops it, its digest, the lengths of its text and of its linked text.
    A block is (element, text).
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.drop, self.digest = ["html"], [-1], [False], [0]
        self.size, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(html)
        self._finish()

    def _read(self, html: str) -> None:
        tag, parent, drop = self.tag, self.parent, self.drop
        stack, opened = [0], Counter({"html": 1})
        pieces: list[tuple[int, str]] = []  # text with its element; element -1 is a block's edge
        layout: list[int] = []
        at, n = 0, len(html)

        def pop() -> None:
            opened[tag[stack[-1]]] -= 1
            if tag[stack.pop()] in BLOCK:
                pieces.append((-1, ""))

        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                pieces.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                pieces.append((stack[-1], html[at : m.start()]))
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                continue
            name, attributes = name.lower(), m.group(3) or m.group(6) or ""
            if m.group(1) or m.group(4):
                if name == "br":
                    pieces.append((stack[-1], " "))
                elif opened[name] and name not in ("html", "body"):
                    while tag[stack[-1]] != name:
                        pop()
                    pop()
                continue
            if name == "br":
                pieces.append((stack[-1], " "))
                continue
            if name in ("html", "body") and opened[name]:
                continue
            if name == "body":
                while len(stack) > 1:
                    pop()
            if name in BLOCK:
                if opened["p"]:
                    self._close(stack, ("p",), pop, tag)
                if opened["head"]:
                    self._close(stack, ("head",), pop, tag)
                pieces.append((-1, ""))
            for other in CLOSES.get(name, ()):
                if opened[other]:
                    self._close(stack, (other,), pop, tag)
            if name in VOID:
                continue
            tag.append(name)
            parent.append(stack[-1])
            inside = opened["article"] or opened["main"]
            named = 0 if name in ("html", "body", "main") else _named(attributes)
            drop.append(name in DROPPED or (name == "header" and not inside) or named == 2)
            if named == 1 and name != "article":
                layout.append(len(tag) - 1)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            stack.append(len(tag) - 1)
            opened[name] += 1
        self._pieces = pieces
        if layout:
            holds = [t in ("article", "main") and not d for t, d in zip(tag, self._down(drop))]
            for i in range(len(tag) - 1, 0, -1):
                holds[parent[i]] |= holds[i]
            for i in layout:
                drop[i] |= not holds[i]

    @staticmethod
    def _close(stack: list[int], names: tuple[str, ...], pop, tag: list[str]) -> None:
        """End the nearest open element of ``names``, unless an element that starts a new scope holds it."""
        for i in range(len(stack) - 1, 0, -1):
            if tag[stack[i]] in names:
                while len(stack) > i:
                    pop()
                return
            if tag[stack[i]] in SCOPES:
                return

    def _finish(self) -> None:
        n = len(self.tag)
        inside, texts = [False] * n, [[] for _ in range(n)]
        for i in range(1, n):
            inside[i] = self.tag[i] == "a" or inside[self.parent[i]]
        self.size, self.linked = [0] * n, [0] * n
        self._text = [(i, unescape(t) if "&" in t else t) for i, t in self._pieces]
        for i, t in self._text:
            if i >= 0 and (clean := _BLANKS.sub(" ", t).strip(" ")):
                texts[i].append(clean)
                self.size[i] += len(clean)
                self.linked[i] += len(clean) * inside[i]
        # children come after their parents: from the last element up
        children: list[list[int]] = [[] for _ in range(n)]
        self.digest = [0] * n
        for i in range(n - 1, -1, -1):
            key = f"{self.tag[i]}\x00{chr(1).join(texts[i])}\x00{','.join(map(str, reversed(children[i])))}"
            self.digest[i] = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))
            if i:
                up = self.parent[i]
                children[up].append(self.digest[i])
                self.size[up] += self.size[i]
                self.linked[up] += self.linked[i]

    def _down(self, own: list[bool]) -> list[bool]:
        out = list(own)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def marked(self) -> tuple[list[bool], bool]:
        """Which elements are in the marked article, and whether there is one."""
        gone = self._down(self.drop)
        for name in ("article", "main"):
            own = [t == name and not g for t, g in zip(self.tag, gone)]
            if any(own):
                return self._down(own), True
        return [True] * len(self.tag), False

    def candidates(self) -> tuple[int, list[tuple[int, int, bool]]]:
        """The article's digest, and element, digest and whether half of the host's articles must hold it, for each subtree that may be a template."""
        article, there = self.marked()
        text = self.text(frozenset())
        out = []
        for i in range(1, len(self.tag)):
            if not self.size[i] or self.tag[i] in ("html", "body", "head", "article", "main", *RAW):
                continue
            outside, links = there and not article[i], self.linked[i] == self.size[i]
            if self.tag[i] in TEXTUAL and there and article[i]:
                continue
            out.append((i, self.digest[i], not (outside or links)))
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")), out

    def text(self, templates: frozenset[int]) -> str:
        """The main text without the elements ``templates``."""
        article, _ = self.marked()
        gone = self._down([d or i in templates for i, d in enumerate(self.drop)])
        blocks: list[str] = []
        here: list[str] = []
        for i, t in [*self._text, (-1, "")]:
            if i >= 0:
                if article[i] and not gone[i]:
                    here.append(t)
            elif here:
                block = _BLANKS.sub(" ", "".join(here)).strip(_SPACE)
                if block:
                    blocks.append(block)
                here = []
        return "\n".join(blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(site: str, digest: int, half: bool) -> int:
    """One number for a subtree of a host, and for which of the two rules applies to it."""
    return _signed((xxhash.xxh64_intdigest(f"{site}\x00{int(half)}".encode()) ^ (digest * 0x9E3779B97F4A7C15)) & _MASK)


def _found(batches: Batches) -> Batches:
    """For each page with a host: host, key (null: the page itself), half, article."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            hosts, keys, halves, articles = [], [], [], []
            for site, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                if not site or not html.is_valid:
                    continue
                article, some = Page(html.as_py()).candidates()
                mine = {(_key(site, d, half), half) for _, d, half in some}
                hosts += [site] * (len(mine) + 1)
                keys += [None, *(k for k, _ in mine)]
                halves += [False, *(h for _, h in mine)]
                articles += [_signed(article)] * (len(mine) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(halves, pa.bool_()), pa.array(articles, pa.int64())], ["host", "key", "half", "article"])


def templates(pages: DataFrame) -> DataFrame:
    """key of each site template of pages (host, html)."""
    found = pages.select("host", "html").mapInArrow(_found, "host string, key long, half boolean, article long")
    once = found.groupBy("host", "key", "half", "article").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "key", "half").agg(F.count("*").alias("n"))
    counts = settled(counts.where((F.col("n") >= MANY) | F.col("key").isNull()), run_folder(pages.sparkSession), "counts")
    sites = counts.where("key is null").select("host", F.col("n").alias("whole"))
    often = counts.where(f"key is not null and n >= {MANY}").join(sites, "host")
    return often.where("not half or 2 * n >= whole").select("key").distinct()


def _extract(held):
    """page_id, url, text, n_chars. ``held``: a broadcast of sorted keys, or None if each page brings its own as ``keys``."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = []
                for row, (site, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"))):
                    page = Page(html.as_py() if html.is_valid else "")
                    some = page.candidates()[1] if site else []
                    keys = np.array([_key(site, d, half) for _, d, half in some], np.int64)
                    known = held.value if held is not None else np.sort(np.array(batch.column("keys")[row].as_py() or [], np.int64))
                    if len(known) and len(keys):
                        hit = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
                        texts.append(page.text(frozenset(i for (i, _, _), h in zip(some, hit) if h)))
                    else:
                        texts.append(page.text(frozenset()))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def _keys_of(batches: Batches) -> Batches:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            keys = []
            for site, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                keys.append(sorted({_key(site, d, half) for _, d, half in Page(html.as_py()).candidates()[1]}) if site and html.is_valid else [])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("same"), pa.array(keys, pa.list_(pa.int64()))], ["host", "same", "keys"])


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", most: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), host(F.col(url).cast("string")).alias("host"), F.col(html).cast("string").alias("html"))
    schema = f"page_id {dict(source.dtypes)['page_id']}, url string, text string, n_chars long"
    known = settled(templates(source), run_folder(spark), "templates")
    if known.count() <= most:
        held = spark.sparkContext.broadcast(np.sort(known.toArrow().column("key").to_numpy()))
        return source.mapInArrow(_extract(held), schema)
    # too many to send: equal pages of a host are joined once with the templates that they hold
    same = source.withColumn("same", F.xxhash64("html"))
    slim = same.where("host <> ''").dropDuplicates(["host", "same"]).select("host", "same", "html").mapInArrow(_keys_of, "host string, same long, keys array<long>")
    mine = slim.select("host", "same", F.explode("keys").alias("key")).join(known, "key").groupBy("host", "same").agg(F.collect_list("key").alias("keys"))
    return same.join(mine, ["host", "same"], "left").select("page_id", "url", "host", "html", "keys").mapInArrow(_extract(None), schema)


_ORACLE_BLOCKS = "|".join(sorted(BLOCK))
ORACLE = rf"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article\b[^>]*>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '\s+|<br\s*/?>', ' ', 'g'), '</?(?:{_ORACLE_BLOCKS})\b[^>]*>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(
  replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&#x27;', ''''), '&amp;?', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), chr(1), '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS t FROM b)
SELECT page_id, url, array_to_string(t, chr(10)) AS text, length(array_to_string(t, chr(10)))::BIGINT AS n_chars FROM c
"""


@query("op11_main_text", ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """All pages."""
    return main_texts(table(spark, folder, "pages"))
