"""URL rules in a sorted digest array.

A rule is ``host/path``: it fits its host and all subdomains when the URL's path starts with its path (from
the slash on).  The index is one file: the sorted 64-bit xxhash keys of all rules, their strings and
verdicts.  Executors get it with ``SparkContext.addFile`` and map it into memory, so workers of one host share
its pages.  A batch of URLs is probed at once: every host suffix with every path prefix whose length some rule
has, one vectorised binary search, and a comparison of the stored string for each digest found.

The longest fitting rule wins; among equally long ones the longer host, then ``block``.  A URL that no
rule fits gets ``default``.  The index is built on the driver from at most ``MOST`` rules; longer lists are to
be split.

Defined cases: a null URL or one without ``://`` has an empty host and path, which no rule fits; an empty path
does not start with ``/``; ports and user names stay part of the host; repeated rows are judged
alike; an empty rule list gives ``default`` for all; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.registry import query, table

MOST, PROBE = 5_000_000, 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


class DigestIndex:
    """The memory-mapped file: n and the number of path lengths, keys, string ends, host lengths, verdicts, path lengths, strings."""

    def __init__(self, file: str):
        n, k = (int(x) for x in np.fromfile(file, np.int64, 2))
        at = 16

        def part(kind: type, size: int) -> np.ndarray:
            nonlocal at
            out = np.memmap(file, kind, "r", at, (size,)) if size else np.zeros(0, kind)
            at += out.nbytes
            return out

        self.keys, self.ends, self.hosts, self.lengths, self.blocked = part(np.uint64, n), part(np.int64, n), part(np.int64, n), part(np.int64, k), part(np.uint8, n)
        self.data = part(np.uint8, int(self.ends[-1]) if n else 0)

    @staticmethod
    def save(rules: Iterable[tuple[str, str]], file: str) -> None:
        """Write (verdict, host/path) rules; a rule named twice is blocked if one of them says so."""
        held: dict[bytes, int] = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block") or "/" not in rule:
                raise ValueError(f"not a rule: {verdict!r} {rule!r}")
            h, slash, rest = rule.partition("/")
            key = (h.translate(str.maketrans(UPPER, LOWER)) + slash + rest).encode()
            held[key] = max(held.get(key, 0), int(verdict == "block"))
        if len(held) > MOST:
            raise ValueError(f"{len(held)} rules; one index holds {MOST}")
        rows = sorted((xxhash.xxh64_intdigest(s), s, b) for s, b in held.items())
        lengths = sorted({len(s) - s.index(b"/") for _, s, _ in rows})
        with open(file, "wb") as f:
            f.write(np.array([len(rows), len(lengths)], np.int64).tobytes())
            f.write(np.array([r[0] for r in rows], np.uint64).tobytes())
            f.write(np.cumsum([len(r[1]) for r in rows], dtype=np.int64).tobytes())
            f.write(np.array([r[1].index(b"/") for r in rows], np.int64).tobytes())
            f.write(np.array(lengths, np.int64).tobytes())
            f.write(np.array([r[2] for r in rows], np.uint8).tobytes())
            f.write(b"".join(r[1] for r in rows))

    def rule(self, i: int) -> bytes:
        return self.data[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def candidates(self, host: str, path: str) -> Iterator[bytes]:
        raw, tail, lengths = host.encode(), path.encode(), self.lengths
        at = 0
        while at >= 0 and raw:
            for k in lengths.tolist():
                if k <= len(tail):
                    yield raw[at:] + tail[:k]
            at = raw.find(b".", at) + 1 or -1

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, bool]]:
        """The winning rule of each URL and whether it blocks."""
        owner, names = [], []
        for i, (h, p) in enumerate(zip(hosts, paths)):
            for c in self.candidates(h, p):
                owner.append(i)
                names.append(c)
        digests = np.array([xxhash.xxh64_intdigest(c) for c in names], np.uint64)
        left, right = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        best: list[tuple] = [(-1, -1, False, None)] * len(hosts)
        for k in np.flatnonzero(left < right).tolist():
            for i in range(left[k], right[k]):
                if self.rule(i) == names[k]:
                    best[owner[k]] = max(best[owner[k]], (len(names[k]), int(self.hosts[i]), bool(self.blocked[i]), names[k]), key=lambda x: x[:3])
        return [(b[3].decode() if b[3] is not None else None, b[2]) for b in best]


_OPEN: dict[str, DigestIndex] = {}


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    rules = list(rules)
    name = f"urls-{hashlib.sha1(repr(rules).encode()).hexdigest()}.idx"
    made = os.path.join(tempfile.gettempdir(), name)  # on the driver, which serves it to the executors
    DigestIndex.save(rules, made)
    pages.sparkSession.sparkContext.addFile(made)
    source = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    kind = dict(source.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _OPEN:
            _OPEN[name] = DigestIndex(SparkFiles.get(name))
        index = _OPEN[name]
        for whole in batches:
            for at in range(0, whole.num_rows, PROBE):
                batch = whole.slice(at, PROBE)
                found = index.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
                verdict = [default if r is None else "block" if b else "allow" for r, b in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return source.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


_FITS = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{h}/{p}'" for h, _, p in sorted((r.partition("/") for _, r in RULES), key=lambda x: -len("".join(x)))
) + " END"
ORACLE = f"""
SELECT page_id, host, path, rule, CASE WHEN rule IN ({', '.join(f"'{r}'" for v, r in RULES if v == 'block')}) THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, {_FITS} AS rule FROM (SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages))
"""


@query("op6_url_rules", ORACLE)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """All pages against the fixed rules."""
    return judge_urls(table(spark, folder, "pages"), RULES)
