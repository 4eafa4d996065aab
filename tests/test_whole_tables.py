"""Queries that once read a part of their table, or fitted a part of their model."""

from __future__ import annotations

from strideframe.plans.registry import Tables, load_all

SMALL = "/root/testdata/sf0.001"


def test_every_vector_asks_for_its_neighbours(spark):
    t = Tables(spark, SMALL)
    found = load_all()["m07_approximate_neighbours"].plan(t)
    asked = {r.vec_id for r in t.embeddings.select("vec_id").collect()}
    got = found.groupBy("query_id").count().collect()
    assert {r.query_id for r in got} == asked
    assert {r["count"] for r in got} == {5}
