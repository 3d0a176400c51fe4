from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm.sampled_pieces import Sampler, decode_pieces, sample_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world\nx", "  a ", "", None, "日本 \t é́ ﬁ ①", "▁ under▁bar", "x" * 300, "a\n\nb c", "\n", "the thing 3.14"]


def brute(voc, text):
    """Every segmentation and its probability."""
    full = " " + text if text else ""
    literal = {i + 1 for i, c in enumerate(text or "") if c == "▁"}
    cuts = {i for i in range(1, len(full) + 1) if i == len(full) or (full[i] == " " and full[i - 1] != " ") or full[i] in "\n▁" or full[i - 1] in "\n▁"}
    out = []

    def go(i, ids, w):
        if i == len(full):
            out.append((tuple(ids), w))
            return
        for j in range(i + 1, min(len(full), i + 16) + 1):
            if any(c in cuts for c in range(i + 1, j)):
                break
            found = voc.weight.get(full[i:j]) if not (j == i + 1 and i in literal) else None
            if found:
                go(j, [*ids, found[0]], w + found[1])
            elif j == i + 1:
                b = full[i].encode()
                go(j, [*ids, *(voc.byte_ids[x] for x in b)], w + voc.byte_weight * len(b))

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {ids: w - total for ids, w in out}


@pytest.mark.parametrize("text", ["abc", "the cat", "a  b", "né\nx▁", "日x", ""])
def test_all_paths_without_replacement(text):
    want = brute(Sampler(MODEL).vocabulary, text)
    got = Sampler(MODEL, k=len(want) + 5).batch(["key"], [text])[0]
    assert len(got) == len(want) == len({tuple(ids.tolist()) for ids, _, _ in got})
    for ids, logp, score in got:
        assert abs(logp - want[tuple(ids.tolist())]) < 1e-9
        assert score == 0.0  # all are included


def test_samples_follow_the_distribution():
    sampler = Sampler(MODEL, k=2)
    want = brute(sampler.vocabulary, "there")
    n = 6000
    paths = sampler.batch(list(range(n)), ["there"] * n)
    firsts = Counter(tuple(p[0][0].tolist()) for p in paths)
    seconds = Counter(tuple(p[1][0].tolist()) for p in paths)
    p = {ids: np.exp(w) for ids, w in want.items()}
    pairs = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    for ids in p:
        assert abs(firsts[ids] / n - p[ids]) < 4 * np.sqrt(p[ids] / n) + 1e-3
        assert abs(seconds[ids] / n - pairs[ids]) < 4 * np.sqrt(pairs[ids] / n) + 1e-3
    # the inverse inclusion scores estimate the number of segmentations without bias
    sizes = [sum(np.exp(-score) for _, _, score in own) for own in Sampler(MODEL, k=6).batch(list(range(2000)), ["there"] * 2000)]
    assert abs(np.mean(sizes) - len(want)) < 5 * np.std(sizes) / np.sqrt(2000)


def test_rows_do_not_depend_on_batches():
    together = Sampler(MODEL, k=3).batch([1, 2, 3, 4], ["one text here", "two", "three\nlines of it", "four words in here"])
    alone = [Sampler(MODEL, k=3).batch([i], [t])[0] for i, t in ((1, "one text here"), (2, "two"), (3, "three\nlines of it"), (4, "four words in here"))]
    for a, b in zip(together, alone):
        assert [x.tolist() for x, _, _ in a] == [x.tolist() for x, _, _ in b]
        assert np.allclose([x[1:] for x in a], [x[1:] for x in b])


def test_frame_and_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no key", "x"), (2, "twice", "x"), (2, "twice", "x"), (99, "long words " * 20_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, path string")
    out = decode_pieces(sample_pieces(frame, MODEL, k=3), MODEL).collect()
    assert all(r.round_trip and r.log_prob <= 0 and r.log_inclusion <= 0 for r in out)
    texts = {(i, t or "") for i, t, _ in rows}
    assert {(r.doc_id, r.decoded) for r in out} == texts
    assert Counter(r.doc_id for r in out)[99] == 3 and Counter((r.doc_id, r.decoded) for r in out)[3, ""] == 1
    distinct = {(r.doc_id, r.decoded, tuple(r.ids)) for r in out}
    assert len(distinct) == len(out) - 3  # the repeated row
    assert sample_pieces(frame.limit(0), MODEL).count() == 0
