import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomery.llm import token_records
from loomery.llm.shared import file_system
from loomery.llm.token_records import WordEncoder, framed, read_manifest, read_records, read_some, unframed, write_records

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's 3.5 KM away now", "áè ΣΑΣ İ ß", "<|endoftext|> <|startoftext|>x", "tab\tnew\r\nline\x1cgs", "​", "日本語 テスト", "x" * 5000, "don't'll 've", " ", "a  b", "́ x"]


def whole(text):
    return WordEncoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_equal_whole_texts():
    encoder = WordEncoder(PATH)
    rng = random.Random(1)
    texts = ODD + ["A.B. x...,; 3.5?! é! İ. 's. it's. Ab!", "!? ..a.."] + ["".join(rng.choice("aB'é1 .,!\n\t<|>Σ́") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert encoder.ids(t) + [2] == whole(t), t


def test_added_tokens_in_any_case():
    encoder = WordEncoder(PATH)
    for t in ["<|ENDOFTEXT|>", "x <|EndOfText|>.", "A<|STARTOFTEXT|>b", "<|endoftext|>", "a<|endoftext|>B.", "<|startoftext|>x.", "<|ENDOFTEXT|> <|endoftext|>,", "<|x|>"]:
        assert encoder.ids(t) + [2] == whole(t), t
        assert WordEncoder(PATH).ids(t) + [2] == whole(t), t


def test_frames():
    data = framed(b"one") + framed(b"") + framed(b"x" * 70000)
    at, got = 0, []
    while at < len(data):
        payload, at = unframed(data, at)
        got.append(payload)
    assert got == [b"one", b"", b"x" * 70000]
    for place in (0, 9, 13, len(framed(b"one")) - 1):
        broken = bytearray(framed(b"one"))
        broken[place] ^= 1
        with pytest.raises(ValueError):
            unframed(bytes(broken))
    with pytest.raises(ValueError):
        unframed(framed(b"one")[:-1])


def test_round_trip(spark, tmp_path):
    docs = [(i * 7 % 101, t) for i, t in enumerate(ODD * 3)] + [(500, None), (501, ""), (500, "again"), (-3, "minus"), (None, "none")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int")
    write_records(frame, f"file://{tmp_path}/r", PATH, shards=3)
    want, start = [], 0
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = whole(text)
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    rows = read_records(spark, f"file://{tmp_path}/r").collect()
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == want
    manifest = read_manifest(f"file://{tmp_path}/r")
    assert manifest["tokens"] == start and len(manifest["shards"]) <= 3
    fs, folder = file_system(f"file://{tmp_path}/r")
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith(".")]


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    write_records(none, f"file://{tmp_path}/e", PATH)
    assert read_records(spark, f"file://{tmp_path}/e").count() == 0


def test_shuffled_reads(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(60)]
    write_records(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, shards=3)
    seen = {}
    for shard in read_manifest(path)["shards"]:
        places = list(range(shard["records"]))
        random.Random(3).shuffle(places)
        for doc, ids in read_some(path, shard["name"], places):
            seen[doc] = ids.tolist()
    assert seen == {i: whole(t) for i, t in rows}


def test_a_word_is_learned_once_in_any_case_and_with_any_marks():
    encoder = WordEncoder(PATH)
    assert encoder.ids("Ab, AB. ab aB! ab, (ab)")[:1] == encoder.ids("ab")
    assert set(encoder.known) == {b"ab", b",", b".", b"!", b"(ab)"}


def test_arrays_of_texts_equal_whole_texts():
    rng = random.Random(2)
    texts = ODD + [None, "", " \n"] + [" ".join("".join(rng.choice("abéÉçßñøāŒ'.,<|") for _ in range(rng.randint(1, 9))) for _ in range(12)) for _ in range(300)]
    library = WordEncoder(PATH).tokenizer
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u2").tobytes() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        values, encoder = pa.array(texts, kind), WordEncoder(PATH)
        assert encoder.encoded_all(values) == want and encoder.encoded_all(values.slice(5, 40)) == want[5:45]
        assert encoder.encoded_all(values.slice(0, 0)) == [] and encoder.encoded_all(pa.array([None, ""], kind)) == [encoder.end] * 2


def test_a_full_cache_forgets_nothing_that_is_needed(monkeypatch):
    monkeypatch.setattr(token_records, "CACHE_WORDS", 5)
    encoder = WordEncoder(PATH)
    for t in ["one two, three", "four one. two,", "one! two? five six seven eight", "one, two."]:
        assert encoder.ids(t) + [2] == whole(t)
