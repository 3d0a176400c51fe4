"""Byte pairs in flat arrays against the library, the pattern and a merge loop written out."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomery.operators import bytepairs as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    " ", "\n", "  ", "\t", "a", "b", "é", "'s", "'re", "'l", "'", "'t", "''", "12", "5", "!?", "日本", "\0", "​", "Ġ", "aaaa", "the", " the", "ing", "\x85", "\x1c", "\xa0", "ß", "𝔘",
]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def test_ids_equal_the_library(library):
    many = texts(20_000, 1) + ["x" * 3000, "ab" * 2000, " " * 500 + "end", "\n" * 40]
    got = B.loaded(PATH).encoded(pa.array(many)).to_pylist()
    assert got == [e.ids for e in library.encode_batch(many, add_special_tokens=False)]


def test_ids_on_whole_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.ids for r in docs.select("doc_id", B.encode(F.col("text"), PATH).alias("ids")).collect()}
    rows = docs.collect()
    assert [got[r.doc_id] for r in rows] == [e.ids for e in library.encode_batch([r.text for r in rows], add_special_tokens=False)]


def test_words_equal_the_pattern():
    many = texts(20_000, 2)
    words, owner = B.split_texts(pa.array(many))
    got = [[] for _ in many]
    for w, i in zip(words.to_pylist(), owner.tolist()):
        got[i].append(w.decode())
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in many]


def test_digits_alone():
    words, _ = B.split_texts(pa.array(["pin 100 on", "x12  3", "a'st 4\n5"]), digits_alone=True)
    assert [w.decode() for w in words.to_pylist()] == ["pin", " ", "1", "0", "0", " on", "x", "1", "2", " ", " ", "3", "a", "'s", "t", " ", "4", "\n", "5"]


def one_by_one(ids, ranks):
    """The merge loop as it is defined: the lowest rank, the leftmost place, one merge at a time."""
    while True:
        best = min(((ranks[a, b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (a, b) in ranks), default=None)
        if best is None:
            return ids
        i = best[1]
        ids = ids[:i] + [ranks[ids[i], ids[i + 1]][1]] + ids[i + 2 :]


@pytest.mark.parametrize("seed", range(6))
def test_merges_equal_the_loop(seed):
    rng = random.Random(seed)
    vocabulary = {c: i for i, c in enumerate("abc")}
    merges = []
    while len(merges) < 25:  # each merge joins tokens that are there
        a, b = rng.choice(list(vocabulary)), rng.choice(list(vocabulary))
        if (a, b) not in merges and a + b not in vocabulary:
            merges.append((a, b))
            vocabulary[a + b] = len(vocabulary)
    ranks = {(vocabulary[a], vocabulary[b]): (i, vocabulary[a + b]) for i, (a, b) in enumerate(merges)}
    words = [[rng.randrange(3) for _ in range(rng.randint(1, 30))] for _ in range(200)]
    table = B.BytePairs(vocabulary, merges)
    ids, of = table.merged(np.concatenate([np.array(w) for w in words]), np.repeat(np.arange(200), [len(w) for w in words]))
    assert [ids[of == i].tolist() for i in range(200)] == [one_by_one(w, ranks) for w in words]
    assert np.all(np.diff(table.keys) > 0) and table.found(np.array([-5, 1 << 50])).tolist() == [-1, -1]


def test_decoding(spark):
    many = [*texts(300, 3), None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(many)], "i int, text string").repartition(3)
    out = frame.select("i", B.decode(B.encode(F.col("text"), PATH), PATH).alias("bytes"), F.size(B.words(F.col("text"))).alias("n")).collect()
    assert {r.i: None if r.bytes is None else bytes(r.bytes).decode() for r in out} == dict(enumerate(many))
    assert {r.i: r.n for r in out if many[r.i] is not None} == {i: len(regex.findall(public_tokenizers.PATTERN, t)) for i, t in enumerate(many) if t is not None}
    bad = spark.createDataFrame([([1, 60_000],)], "ids array<int>").select(B.decode(F.col("ids"), PATH).alias("x"))
    with pytest.raises(Exception, match="not in the vocabulary"):
        bad.collect()


def test_the_table_sorted(spark):
    from loomery.operators.ordinals import with_ordinal

    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)["model"]
    rows = with_ordinal(B.merge_table(spark, PATH), "packed").orderBy("place").collect()
    assert len(rows) == len(model["merges"]) and [r.place for r in rows] == list(range(1, len(rows) + 1))
    for r in rows[::997]:
        a, b = model["merges"][r["rank"]]
        assert r.packed == model["vocab"][a] << 32 | model["vocab"][b] and r.made == model["vocab"][a + b]


def test_slices_bound_what_is_worked_on_at_a_time(monkeypatch):
    many = pa.array(["x" * 700, None, "", "é" * 200, "y" * 5000, *texts(300, 9)])
    for values in (many, many.slice(3), many.cast(pa.large_string()), B.loaded(PATH).encoded(many), many.slice(0, 0)):
        parts = list(B.slices(values, 1000))
        assert pa.concat_arrays(parts).equals(values)
        assert all(len(p) == 1 or sum(len(x or "") * (1 if isinstance(x, str) else 4) for x in p.to_pylist()) <= 1000 for p in parts)
    seen = []
    split = B.split_texts
    monkeypatch.setattr(B, "SLICE_BYTES", 1000)
    monkeypatch.setattr(B, "split_texts", lambda t, *more: seen.append(sum(len((x or "").encode()) for x in t.to_pylist() if len(t) > 1)) or split(t, *more))
    from pyspark.sql import functions as F_

    monkeypatch.setattr(F_, "arrow_udf", lambda run, kind: lambda column: run(column))
    assert B.encode(many, PATH).equals(B.loaded(PATH).encoded(many)) and B.words(many).to_pylist()[:3] == [["x" * 700], None, []]
    assert B.decode(B.encode(many, PATH), PATH).to_pylist() == [None if x is None else x.encode() for x in many.to_pylist()]
    assert len(seen) > 10 and sorted(seen)[-2] <= 1000  # one call with all at once is this test's own


def test_pairs_that_no_merge_touched_are_looked_up_once(monkeypatch):
    table = B.loaded(PATH)
    looked, found = [], table.found
    monkeypatch.setattr(table, "found", lambda pairs: looked.append(len(pairs)) or found(pairs))
    word = "".join(random.Random(4).choices("etaoinshr", k=20_000))
    ids = table.encoded(pa.array([word])).to_pylist()[0]
    assert sum(looked) < 4 * len(word) and len(ids) < len(word)


def test_slots_that_several_pairs_share(monkeypatch):
    monkeypatch.setattr(B, "SLOT_BITS", 3)
    vocabulary = {chr(97 + i): i for i in range(20)}
    merges = [(a, b) for a in list(vocabulary) for b in list(vocabulary)]
    vocabulary |= {a + b: 20 + i for i, (a, b) in enumerate(merges)}
    table = B.BytePairs(vocabulary, merges)
    assert table.found(table.keys).tolist() == list(range(400)) and set(table.found(table.keys + 20).tolist()) <= {-1, *range(400)}
    assert table.found(np.array([25 << 32, 20, -1])).tolist() == [-1] * 3


def test_decoded_lists_of_a_slice():
    table = B.loaded(PATH)
    many = pa.array(["ab cd", None, "", "é" * 9, "日本 x"])
    ids = table.encoded(many)
    assert table.decoded(ids.slice(2, 3)).to_pylist() == [b"", ("é" * 9).encode(), "日本 x".encode()]
    assert table.decoded(ids.slice(1, 1)).to_pylist() == [None] and table.decoded(ids.slice(0, 0)).to_pylist() == []
    assert B.BytePairs({"a": 0, "b": 2}, []).decoded(pa.array([[0, 2]])).to_pylist() == [b"ab"]
    with pytest.raises(ValueError, match="not in the vocabulary"):
        B.BytePairs({"a": 0, "b": 2}, []).decoded(pa.array([[1]]))
