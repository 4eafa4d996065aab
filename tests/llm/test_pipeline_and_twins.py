"""The pipeline against brute force, and the SQL twins."""

from __future__ import annotations

import os

import corpus_pipeline
import pytest
from compare import difference, duck

from strideframe.llm import minhash, substring
from strideframe.llm.registry import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_equal_brute_force(spark, con, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [[(r.doc_id, r.text) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append([(r[0], r[1]) for r in docs.collect()])
        assert docs.columns == columns or name == "tokens"
    raw, clean, unique, cut, free, tokens = seen
    assert 0 < len(clean) <= len(raw) and set(clean) <= set(raw)
    heads = {c for _, c in minhash.brute_force(clean, 80).values()}
    assert {i for i, _ in unique} == heads
    import hashlib

    want = {i: b for (i, _), b in zip(unique, substring.brute_force([t for _, t in unique]))}
    texts = dict(unique)
    assert all(t == texts[i] if want[i][1] == 0 else hashlib.sha256(t.encode()).hexdigest() == want[i][2] for i, t in cut)
    assert {i for i, _ in free} <= {i for i, _ in cut} and {i for i, _ in tokens} == {i for i, _ in free}
    assert docs.where("decoded_sha256 is null").isEmpty()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()) == sorted(i for i, _ in tokens)
