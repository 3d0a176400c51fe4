import random

import pytest
from pyspark.sql import functions as F

from loomery.llm.decontaminate import Search, clean_words, find_hits, n_hit


def brute(text, items, window=10):
    words, hit, found = clean_words(text), set(), set()
    for item, body in items:
        w = clean_words(body)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[i : i + size]:
                    hit.update(range(at, at + size))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.fixture
def case():
    rng = random.Random(7)
    vocab = ["ab", "b1", "Cé", "d", "ee", "ff"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [("1", line(14)), ("2", line(10)), ("10", line(3)), ("x", line(1)), ("2b", ""), ("same", None)]
    items.append(("1again", items[0][1]))
    docs = [(i, line(rng.randint(0, 80))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..!"), (103, (items[0][1].upper() + ", ") * 300), (103, items[1][1]), (None, items[1][1])]
    return docs, items


def test_search_equals_brute_force(case):
    docs, items = case
    search = Search([x for x in items if x[1]])
    for _, text in docs[:60]:
        spans, found = search.scan(clean_words(text))
        hit = {p for a, b in spans for p in range(a, b)}
        assert (len(clean_words(text)), len(hit), sorted(found)) == brute(text, [x for x in items if x[1]])


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_find_hits(spark, case, block_bytes):
    docs, items = case
    frame = spark.createDataFrame([(i, t, "kept", 5) for i, t in docs], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame([*items, (None, "ab"), items[0]], "item_id string, text string")
    out = find_hits(frame, bench, block_bytes=block_bytes).withColumn("hit", n_hit(F.col("hit_spans")))
    assert out.columns[:4] == frame.columns
    got = sorted((str(r.doc_id), r.text or "", r._n_words, r.hit, r._items) for r in out.collect())
    want = sorted((str(i), t or "", *brute(t, [x for x in items if x[1]])) for i, t in docs)
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_hits(docs, none).collect()[0].hit_spans == []
    assert find_hits(docs.limit(0), none).count() == 0


def test_held_texts_and_blocks(spark, case, monkeypatch):
    from loomery.llm import decontaminate

    monkeypatch.setattr(decontaminate, "HOLD_BYTES", 1)
    monkeypatch.setattr(decontaminate, "SLICE_ROWS", 3)
    docs, items = case
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    few, many = (sorted((str(r.doc_id), r.text or "", r.hit_spans, r.items) for r in find_hits(frame, bench, block_bytes=b).collect()) for b in (1 << 20, 40))
    assert few == many
