import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomery.llm.packing import ByteEncoder, Room, best_fit, op11_packing, pack_documents, padded_sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def held(rows, truth, width=2048, least_cut=16):
    """Checks pieces against the ids of all documents (a list, in any order) and returns the padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    own = defaultdict(list)
    for doc, ids in truth:
        own[doc].append(ids)
    assert docs.keys() == own.keys()
    for doc, pieces in docs.items():
        todo = [[ids, 0] for ids in own[doc]]
        assert sum(r.length for r in pieces) == sum(len(ids) for ids in own[doc])
        for r in sorted(pieces, key=lambda r: (r.start, -r.length)):
            for t in todo:  # a piece continues one of the rows that share the id
                if t[1] == r.start and len(t[0]) == r.doc_tokens and zlib.crc32(np.array(t[0][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32:
                    t[1] += r.length
                    break
            else:
                raise AssertionError(r)
        assert all(at == len(ids) for ids, at in todo)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= width
        if at & (at - 1):
            assert width - at < least_cut
            padding += width - at
    return padding


def test_encoder_equals_the_library(plain):
    rng = random.Random(7)
    alphabet = [" ", "\n", " ", "\t", "a", "B", "é", "ß", "<|endoftext|>", "<|end", "\x1c", "\x85", "'s", "12", "!?", "日", "\0", "\x01", "​", "Ġ", "word", ".", ",###"]
    encoder = ByteEncoder(PATH, 1)
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encoded(text), encoder.dtype).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_encoder_beyond_its_memory(plain, monkeypatch):
    from loomery.llm import packing

    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    encoder, rng = ByteEncoder(PATH, 1), random.Random(2)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcde.") for _ in range(rng.randint(1, 4))) for _ in range(20))
        assert np.frombuffer(encoder.encoded(text), encoder.dtype).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
        assert len(encoder.known) <= 50


def test_room_finds_the_tightest():
    rng, room, held_ = random.Random(1), Room(64), []
    for i in range(3000):
        if rng.random() < 0.55 or not held_:
            cap = rng.randint(1, 63)
            room.put(cap, i)
            held_.append(cap)
        else:
            need = rng.randint(1, 64)
            fits = [c for c in held_ if c >= need]
            got = room.take(need)
            assert (got[1] if got else None) == (min(fits) if fits else None)
            if got:
                held_.remove(got[1])


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000, 1, 1], [1100] * 50, [1025] * 3, [2047] * 9, [3] * 700, [2033] * 5, list(range(1, 2300, 7))])
def test_best_fit(lengths):
    sequences = best_fit(lengths)
    tokens = sorted((i, t) for s in sequences for i, at, n in s for t in range(at, at + n))
    assert tokens == [(i, t) for i, n in enumerate(lengths) for t in range(n)]
    for s in sequences:
        n = sum(p[2] for p in s)
        assert 0 < n <= 2048 and (n & (n - 1) == 0 or 2048 - n < 16)
    cut = sum(len(s) for s in sequences) - sum(-(-n // 2048) for n in lengths)
    assert cut <= len(sequences) + 11  # hardly more cuts than windows


def test_pieces_hold_every_token_once(spark, plain):
    rng = random.Random(3)
    words = ["alpha", "beta,", "gamma", "Zürich", "x", "\n", "été.", "<|endoftext|>"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 300, 900])))) for i in range(150)]
    docs += [(500, None), (501, ""), (7, docs[7][1]), (8, "another"), (None, "no id"), (None, None), (502, "long word " * 9000), (503, "\n\n  \t")]
    frame = spark.createDataFrame([(t, i, 1, "x") for i, t in docs], "text string, doc_id long, length int, `a.b` string").repartition(3)
    got = pack_documents(frame, PATH, block_tokens=20_000)
    rows = got.collect()
    truth = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in docs]
    padding = held(rows, truth)
    assert padding <= 0.008 * sum(len(x) for _, x in truth)
    full = padded_sequences(got, pad_id=9).collect()
    assert len(full) == len({r.sequence_id for r in rows})
    assert all(len(r.input_ids) == 2048 or (len(r.input_ids) & (len(r.input_ids) - 1)) == 0 for r in full)
    assert pack_documents(frame.limit(0), PATH).count() == 0


def test_query_on_its_table(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    truth = [(r.doc_id, [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs]
    padding = held(op11_packing(spark, "/root/testdata/sf0.001").collect(), truth)
    assert padding <= 0.008 * sum(len(x) for _, x in truth)
