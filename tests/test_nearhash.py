"""The Hamming index, its groups and first-come selection against all pairs."""

from __future__ import annotations

import random

import pytest

from strideframe.operators import nearhash


def _hashes(seed: int, n: int):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        h = rng.choice(bases)
        for _ in range(rng.randrange(9)):
            h ^= 1 << rng.randrange(64)
        out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)


def _bits(a: int, b: int) -> int:
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("hot", [5, 10_000])
@pytest.mark.parametrize("within", [1, 4, 6])
def test_near_pairs_are_all_pairs(spark, hot, within):
    data = [(k, h) for k in (1, 2) for h in _hashes(k, 150)]
    got = nearhash.near_pairs(spark.createDataFrame(data, "rec int, hash long"), ["rec"], within, hot).collect()
    want = {(k, a, b) for k in (1, 2) for a in _hashes(k, 150) for b in _hashes(k, 150) if a < b and _bits(a, b) < within}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and (want or within == 1)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2003, 2001), (2002, 2003), (5, 5)]
    got = {r.id: r.comp for r in nearhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, 2001: 2001, 2002: 2001, 2003: 2001}
    assert nearhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_duplicate_groups(spark):
    hashes = _hashes(7, 80)
    data = [(i, hashes[i % 80] if i % 11 else None) for i in range(200)]
    got = {r.frame: r for r in nearhash.duplicate_groups(spark.createDataFrame(data, "frame int, phash long"), "phash", 5).collect()}
    comp = {h: h for h in hashes}
    for _ in hashes:
        for a in hashes:
            for b in hashes:
                if _bits(a, b) < 5:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    size = lambda g: sum(h is not None and comp[h] == g for _, h in data)
    assert all((got[i].group_hash, got[i].copies) == ((None, None) if h is None else (comp[h], size(comp[h]))) for i, h in data)


@pytest.mark.parametrize("most", [0, 1000])
def test_first_come(spark, most):
    rng = random.Random(3)
    pool = _hashes(4, 60)
    rows = [(k, i, rng.uniform(0, 60), rng.choice(pool), f"x{i}") for k in (1, 2) for i in range(70)]
    got = nearhash.first_come(spark.createDataFrame(rows, "rec int, frame int, t double, phash long, tag string"), ["rec"], "t", "frame", "phash", 0.3, 4, most=most)
    kept: list = []
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if all(k[0] != r[0] or (r[2] - k[2] >= 0.3 and _bits(k[3], r[3]) >= 4) for k in kept):
            kept.append(r)
    assert sorted(tuple(r) for r in got.collect()) == sorted(kept)
