import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import quality, toxicity
from loomery.llm.labelled import fit_logistic, fold_of, labelled_sample

MARKS = ["grimblot", "snarkle", "vexhound"]


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["ta", "re", "mi", "lo", "shu", "ken", "pra", "dol", "es", "an", "ti", "or"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 150))]
        toxic, bad = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(len(words) // 12 + 2):
                words.insert(rng.randrange(len(words)), rng.choice(MARKS))
        if bad:
            words = [w + "$$$" for w in words]
        out.append((i, " ".join(words), int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(1200, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels


ODD = [(None, None, "x"), (9001, None, "x"), (9002, "", "x"), (9003, "w " * 60_000, "x"), (9004, "grimblot", "x"), (9004, "grimblot", "x")]


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, tables, module, label, least):
    docs, labels = tables
    model = module.fitted(docs, labels)
    more = docs.unionByName(spark.createDataFrame(ODD, docs.schema))
    score = {"toxic": toxicity.score_toxicity, "quality": quality.score_quality}[label]
    out = score(more, model)
    assert out.columns == ["doc_id", "text", "score", "_score"]
    rows = out.join(labels, "doc_id").where(module.held_out(F.col("doc_id"))).collect()
    right = sum((r._score >= 0.5) == (r[label] == 1) for r in rows)
    assert len(rows) > 150 and right >= least * len(rows)
    odd = {r.doc_id: r._score for r in out.where("doc_id is null or doc_id > 9000").collect()}
    assert len(odd) == 5 and all(0 <= s <= 1 for s in odd.values())
    assert odd[9001] == odd[9002]
    assert score(docs.limit(0), model).count() == 0


def test_folds_are_kept_out(spark, tables):
    docs, labels = tables
    got = labelled_sample(docs, labels, "toxic", toxicity.held_out, per_class=10_000)
    known = {r.doc_id: (r.text, r.toxic) for r in docs.join(labels, "doc_id").collect()}
    want = sorted((y, t) for i, (t, y) in known.items() if zlib.crc32(str(i).encode()) % 5)
    assert sorted(got) == want
    few = labelled_sample(docs, labels, "toxic", toxicity.held_out, per_class=20)
    assert [y for y, _ in few].count(1) == 20 == [y for y, _ in few].count(0)
    some = labelled_sample(docs, labels, "toxic", toxicity.held_out, per_class=10_000, max_bytes=20_000)
    assert 0 < sum(len(t.encode()) for _, t in some) <= 20_000 and {t for _, t in some} <= {t for _, t in want}
    fold = docs.select("doc_id", fold_of(F.col("doc_id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 for r in fold)


def test_one_class_or_none(spark, tables):
    docs, labels = tables
    one = labels.withColumn("toxic", F.lit(1)).withColumn("quality", F.lit(1))
    assert {r[0] for r in toxicity.score_toxicity(docs.limit(5), toxicity.fitted(docs, one)).select("_score").collect()} == {1.0}
    none = toxicity.score_toxicity(docs.limit(5), toxicity.fitted(docs, labels.limit(0)))
    assert {r[0] for r in none.select("_score").collect()} == {0.0}
    assert quality.score_quality(docs.limit(5), quality.fitted(docs, labels.limit(0))).count() == 5


def test_features_equal_a_plain_count():
    texts = ["ab abc", "", None, "x\n x x", "é" * 4]
    slots, owner = quality.feature_slots(texts, 1 << 30)
    for i, t in enumerate(texts):
        words = (t or "").split()
        grams = sum(max(0, len(w) + 2 - n + 1) for w in words for n in quality.N_GRAMS)
        assert int((owner == i).sum()) == grams + len(words) + max(0, len(words) - 1)
    alone = quality.feature_slots(["ab abc"], 1 << 30)[0]
    assert sorted(alone) == sorted(slots[owner == 0])
    assert quality.REPEATED in slots[owner == 3]


def test_logistic_finds_the_line():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert np.allclose(fit_logistic(x, y, np.ones(4000), 0.01), [2, -1, 0.5], atol=0.25)


def test_rare_and_varied_wording_is_learnt():
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    phrases = [word("bcdfghjklmnpqrstvwxz", 16) for _ in range(120)]  # each in 2.5 % of the toxic texts
    usual = [word("aeiounrst", 6) for _ in range(400)]

    def text(toxic):
        words = [rng.choice(usual) for _ in range(60)]
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(phrases))
        return " ".join(words)

    sample = [(i % 2, text(i % 2)) for i in range(1600)]
    first = [(y, toxicity.folded(t)) for i, (y, t) in enumerate(sample) if i % 3]
    held = toxicity.toxic_segments([t for y, t in first if y], [t for y, t in first if not y])
    assert sum(p.encode() in held for p in phrases) < 40
    score = toxicity.fit(sample).scorer()
    assert sum((score(text(y)) >= 0.5) == y for y in [0, 1] * 150) >= 0.9 * 300


def test_segments_grow_with_the_sample():
    rng = random.Random(6)
    marks = [bytes(rng.choice(b"bcdfgzxvkwqjlmp") for _ in range(40)) for _ in range(60)]
    toxic = [b" ".join(rng.sample(marks, 12)) for _ in range(300)]
    found = toxicity.toxic_segments(toxic, [b" aeiou"] * 300)
    assert all(m in found for m in marks)


def some_texts():
    rng = random.Random(8)
    odd = [None, "", " ", "x", "aa aa aa", "grimblot snarkle", "日本 語", "w " * 300, "\n\t a\n"]
    return odd + [t for _, t, _, _ in rng.sample(corpus(400, 5), 41)]


def test_quality_scores_restated():
    sample = [(q, t) for _, t, q, _ in corpus(300, 3)]
    model = quality.fit(sample, slots=1 << 12)
    step, full = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mixed(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & full
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & full
        return h ^ (h >> 31)

    def score(text):
        words, slots, hashes = (text or "").split(), [], []
        for w in words:
            marked = f" {w} "
            for n in quality.N_GRAMS:
                for i in range(len(marked) - n + 1):
                    h = n
                    for c in marked[i : i + n]:
                        h = (h * step + ord(c)) & full
                    slots.append(mixed(h) % len(model.table))
            hashes.append(mixed(sum((ord(c) + 1) * pow(step, k + 1, 1 << 64) for k, c in enumerate(w)) & full))
        slots += [h % len(model.table) for h in hashes]
        slots += [(quality.REPEATED if a == b else mixed((a * step + b) & full)) % len(model.table) for a, b in zip(hashes, hashes[1:])]
        z = sum(float(model.table[s]) for s in slots) / (quality.PADDING + len(slots)) + model.bias
        return 1 / (1 + np.exp(-min(30, max(-30, z))))

    texts = some_texts()
    assert np.allclose(model.scores(texts), [score(t) for t in texts], atol=1e-9)
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts], atol=1e-12)


def test_toxicity_scores_restated():
    model = toxicity.fit([(x, t) for _, t, _, x in corpus(300, 4)])
    plain, *toxic = model.compressors()
    assert len(toxic) == 2
    score = model.scorer()
    for text in some_texts():
        data = b" " + (text or "").encode().lower() + b" "
        windows, at = [], 0
        while True:
            windows.append(data[at : at + 48])
            at += 32
            if at >= max(1, len(data) - 48 + 32):
                break
        n, x = len(windows), []
        for compress in toxic:
            saved = [len(plain(w)) - len(compress(w)) for w in windows]
            x += [3 * sum(saved) / n, np.sign(sum(saved)) * np.log1p(abs(sum(saved))), min(max(0, *saved, 0), 12) / 4]
            for t in (6, 5, 4, 3, 2, 1):
                many = sum(s >= t for s in saved)
                x.append(np.log1p(many))
                if t in (2, 4):
                    x += [10 * many / n, np.log1p(many) / np.log1p(n), max(0, np.log1p(many) - np.log1p(0.02 * n))]
        x.append(np.log1p(n) / 4)
        z = sum(a * b for a, b in zip(x, model.weights)) + model.weights[-1]
        assert abs(score(text) - 1 / (1 + np.exp(-min(30, max(-30, z))))) < 1e-9, text
