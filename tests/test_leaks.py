"""Contained items and drop summaries against plain Python, with clashing names, nulls, repeats and hot words."""

import random

import pytest
from pyspark.sql import functions as F

from loomery.operators import curate as C


@pytest.mark.parametrize("few", [100_000, 0])
def test_contained_items(spark, few, monkeypatch):
    rng = random.Random(4)
    words = ["the", "cat", "sat", "on", "mat", "a", "zé"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, line(rng.randint(0, 30))) for i in range(200)] + [(500, None), (None, line(20)), (501, "xx the cat sat on the mat yy " * 300), (3, "cat sat on the mat a")]
    items = [(i, line(rng.randint(1, 7))) for i in range(60)] + [(100, ""), (101, None), (None, "cat"), (102, "t the cat sat on the ma"), (102, "the cat sat on the"), (103, "the cat sat on the")]
    a = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "anchor long, item string, w int, body string, `a.b` int").repartition(4)
    b = spark.createDataFrame([(t, i) for i, t in items], "item string, doc long")
    got = C.leaks_contained(a, b, "anchor", "doc", "item", few=few)
    want = {(d, i) for d, t in docs for i, x in items if d is not None and i is not None and t is not None and x and x in t}
    assert got.columns == ["anchor", "doc"] and sorted(map(tuple, got.collect())) == sorted(want)
    monkeypatch.setattr(C, "BLOCK_ITEMS", 3)
    assert sorted(map(tuple, C.leaks_contained(a, b, "anchor", "doc", "item", few=few).collect())) == sorted(want)
    assert C.leaks_contained(a, b.limit(0), "anchor", "doc", "item").count() == 0 == C.leaks_contained(a.limit(0), b, "anchor", "doc", "item").count()


def test_drop_summary(spark):
    rows = [("en", "a"), ("en", "b"), ("en", "a"), ("de", None), (None, "c"), ("de", "b")]
    df = spark.createDataFrame(rows, "lang string, key string").withColumn("hit", F.lit(1))
    drop = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "key string")
    got = {r.lang: (r.n, r.kept, r.dropped) for r in C.drop_summary(df, drop, F.col("key"), F.col("key"), "lang").collect()}
    assert got == {"en": (3, 1, 2), "de": (2, 2, 0), None: (1, 1, 0)}
    assert C.drop_summary(df.limit(0), drop, F.col("key"), F.col("key"), "lang").count() == 0
