"""Quality by supervised subword embeddings.

A document is the mean of the vectors of its words, word pairs and character n-grams, all hashed into one table; a softmax
layer on top gives the classes. Table and layer are trained together by stochastic gradient descent in numpy. Since the
layer is linear, the trained table folds to one number for each slot (the difference of the two classes' logits), and
scoring a document is a mean of look-ups, vectorised over whole batches of text.

Defined results: null and empty texts have no features and get the score of the bias; if the labels have one class only,
every document gets that class' share; repeated rows score alike; extra columns stay and a taken name gets underscores in
front. Whole texts are read; long ones are one span of the batch like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.labelled import fold_of, labelled_sample
from loomery.llm.shared import free_name

SLOTS = 1 << 17
DIM = 12
N_GRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 0.5
PER_CLASS = 3000
BATCH_CHARS = 1 << 20

REPEATED = 77_777
PADDING = 6.0  # features of no weight that every document has: the mean over a few words stays moderate

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def feature_slots(texts: list[str | None], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each feature, document of each feature) of the words, pairs of neighbours and n-grams within words.

    Words are runs without blanks; n-grams see a word with one blank at either end, as their boundary marks.
    """
    bodies = [f" {' '.join(t.split())} " if t else " " for t in texts]
    codes = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(b) for b in bodies])
    blank = codes == 32
    found, owners = [], []
    with np.errstate(over="ignore"):
        for n in N_GRAMS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            inner = np.zeros(m, bool)
            for j in range(n):
                h = h * _MULTIPLIER + codes[j : j + m]
                if 0 < j < n - 1:
                    inner |= blank[j : j + m]
            whole = ~inner & ~(blank[:m] & blank[n - 1 : n - 1 + m] & (n <= 2))
            found.append(_mixed(h[whole]) % np.uint64(slots))
            owners.append(owner[:m][whole])
        starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        if len(starts):
            ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
            power = np.cumprod(np.full(int((ends - starts).max()), _MULTIPLIER, np.uint64))
            letters = np.flatnonzero(~blank)
            place = letters - np.repeat(starts, ends - starts)
            terms = (codes[letters] + np.uint64(1)) * power[place]
            sums = np.add.reduceat(terms, np.r_[0, np.cumsum(ends - starts)[:-1]])
            words = _mixed(sums)
            found.append(words % np.uint64(slots))
            owners.append(owner[starts])
            pair = owner[starts[1:]] == owner[starts[:-1]]
            one, two = words[:-1][pair], words[1:][pair]
            # a pair of equal words is one feature, whatever the word
            both = np.where(one == two, np.uint64(REPEATED), _mixed(one * _MULTIPLIER + two))
            found.append(both % np.uint64(slots))
            owners.append(owner[starts[1:]][pair])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


@dataclass
class QualityModel:
    table: np.ndarray  # a number for each slot
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH_CHARS):
                size += len(texts[end] or "")
                end += 1
            slots, owner = feature_slots(texts[at:end], len(self.table))
            total = np.bincount(owner, self.table[slots], end - at)
            count = np.bincount(owner, minlength=end - at)
            out[at:end] = total / (PADDING + count)
            at = end
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def fit(sample: list[tuple[int, str]], seed: int = 11, slots: int = SLOTS) -> QualityModel:
    """Vectors and softmax layer by SGD, a document a step, classes weighted to their shares' mean."""
    y = np.array([y for y, _ in sample], int)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(slots), float(np.log(share / (1 - share))))
    docs = []
    for _, text in sample:
        found, counts = np.unique(feature_slots([text], slots)[0], return_counts=True)
        docs.append((found, (counts / (PADDING + counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((slots, DIM)) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            found, share = docs[i]
            if not len(found):
                continue
            own = vectors[found]
            mean = share @ own
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = p * np.float32(weight[y[i]] * rate)
            # the rows' gradient is scaled by the number of features, as if each were its own step
            vectors[found] = own - np.outer(share * min(len(found), 200), layer.T @ grad)
            layer -= np.outer(grad, mean)
            bias -= grad * np.float32(0.1)
    table = vectors @ (layer[1] - layer[0])
    return QualityModel(table.astype(np.float64), float(bias[1] - bias[0]))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with a score column: 0 to 1, higher the likelier good. No shuffle; the broadcast table has a fixed size."""
    score = free_name(docs, score)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = pa.array(shared.value.scores(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def held_out(id_col):
    return fold_of(id_col, 4) == 2


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    return fit(labelled_sample(docs, labels, "quality", held_out, per_class=per_class))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
