"""Toxicity by compression distance.

zstandard dictionaries are trained on ordinary and on toxic text, the toxic ones in two breadths. All hold the strings that
zstandard's own trainer finds in ordinary text, so that only what sets toxic text apart makes a difference. The broad toxic one
also holds what the trainer finds in those passages of toxic texts that are more frequent there, the narrow one the segments
that recur in many toxic texts and hardly ever in ordinary ones (cover selection by document frequency). One word of
the narrow kind tells much; of the broad kind it takes several. Every overlapping window of a text is compressed with each;
the bytes that a toxic dictionary saves are its distance. How many windows save how much, of how many, and what is saved in
all, against thresholds calibrated on labelled texts that the dictionaries have not seen, gives the score.

Defined results: null and empty texts, having no window that saves anything, get the score of the intercept; a label
table with one class only gives that class' share, 0.0 or 1.0, to every document, and one without usable labels 0.0; repeated rows are scored alike; extra columns stay
and a taken name gets underscores in front. Whole texts are read, however long, a window at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.labelled import fit_logistic, fold_of, labelled_sample
from loomery.llm.shared import free_name, give_back, lean

WINDOW = 48
STRIDE = 32
GRAM = 5
BASE_BYTES = 39999  # a multiple of FILL
TOXIC_BYTES = 1500  # what the trainer is to find in toxic passages, a multiple of FILL
REACH = 45000  # the size that either dictionary's tables are laid out for, or that of the toxic one where this is larger
FILL = 3  # positions between a dictionary's entries in the compressor's tables
MIN_SHARE = 0.03  # of the toxic texts that a gram of a segment must be in
MIN_RATIO = 60.0  # of its shares in toxic and ordinary texts
PASSAGE_TEXTS = 5  # toxic texts that a gram of a passage must be in
PASSAGE_RATIO = 8.0  # of its occurrences a text in toxic and ordinary ones
OCCURRENCES = 8  # that count in one text
GATHERED = 1 << 20  # grams that are held until they are summed up
LEVEL = 3
SAVED = (1, 2, 3, 4, 5, 6)  # bytes saved, the thresholds
SHARES = (2, 4)  # those of them at which the share of windows counts as well
CHANCE = 0.02  # of the windows, which may save as much by chance
PER_CLASS = 4000


def folded(text: str | None) -> bytes:
    """The text as bytes between blanks, A-Z lower-cased."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" "


def grams(data: bytes, size: int = GRAM) -> np.ndarray:
    """The overlapping runs of size bytes, each as one integer."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(a) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out |= a[j : j + n] << np.uint64(8 * j)
    return out


def without_copies(texts: list[bytes]) -> list[bytes]:
    """One text of each group that shares its least 16-byte run by hash: copies must not make a string look common."""
    seen: dict = {}
    for text in texts:
        g = grams(text, 8)
        if len(g) > 8:
            with np.errstate(over="ignore"):
                h = g[:-8] * np.uint64(0x9E3779B97F4A7C15) + g[8:]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            seen.setdefault(int(h.min()), text)
        else:
            seen.setdefault(text, text)
    return list(seen.values())


def doc_frequency(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Grams and the number of texts each is in; of the wanted ones (sorted) if given."""
    if wanted is None:
        values, _, held = occurrences(texts)
        return values, held
    counts = np.zeros(len(wanted), np.int64)
    for t in texts:
        g = np.unique(grams(t))
        at = np.searchsorted(wanted, g)
        inside = at < len(wanted)
        at, g = at[inside], g[inside]
        counts[at[wanted[at] == g]] += 1
    return wanted, counts


def marked_segments(texts: list[bytes], good: np.ndarray, counts: np.ndarray) -> Counter:
    """Runs of good grams in the texts, their rare ends cut off, by number of texts."""
    out: Counter = Counter()
    for t in texts:
        g = grams(t)
        at = np.searchsorted(good, g)
        at[at == len(good)] = 0
        freq = np.where(good[at] == g, counts[at], 0)
        hits = np.flatnonzero(freq)
        if not len(hits):
            continue
        found = set()
        for run in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1):
            common = run[freq[run] * 2 >= freq[run].max()]
            found.add(t[common[0] : common[-1] + GRAM])
        out.update(found)
    return out


def toxic_segments(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """The strings that set toxic texts apart, the most frequent last; each adds a gram that those before lack."""
    if not toxic:
        return b""
    values, inside = doc_frequency(toxic)
    often = inside >= max(5, MIN_SHARE * len(toxic))
    values, inside = values[often], inside[often]
    _, outside = doc_frequency(ordinary, values)
    apart = inside / len(toxic) >= MIN_RATIO * outside / max(1, len(ordinary))
    good, counts = values[apart], inside[apart]
    if not len(good):
        return b""
    chosen: list[bytes] = []
    covered: set = set()
    for segment, n in sorted(marked_segments(toxic, good, counts).items(), key=lambda x: (-x[1], x[0])):
        own = set(grams(segment).tolist())
        if n < 2 or not own - covered:
            continue
        covered |= own
        chosen.append(segment)
    return b"".join(reversed(chosen))


def occurrences(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams, how often each occurs, OCCURRENCES in a text at most, and in how many texts; of the wanted ones (sorted) if given."""
    if wanted is not None:
        often, held = np.zeros(len(wanted)), np.zeros(len(wanted), np.int64)
        for t in texts:
            g, n = np.unique(grams(t), return_counts=True)
            at = np.searchsorted(wanted, g)
            inside = at < len(wanted)
            same = inside.copy()
            same[inside] = wanted[at[inside]] == g[inside]
            often[at[same]] += np.minimum(n[same], OCCURRENCES)
            held[at[same]] += 1
        return wanted, often, held
    whole = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting, size = [], 0
    for i, t in enumerate(texts):
        g, n = np.unique(grams(t), return_counts=True)
        waiting.append((g, np.minimum(n, OCCURRENCES), np.ones(len(g), np.int64)))
        size += len(g)
        if size > GATHERED or i == len(texts) - 1:
            whole = added([whole, *waiting])
            waiting, size = [], 0
    return whole


def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of grams, those of equal grams summed."""
    values, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    out = []
    for k in (1, 2):
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, place, np.concatenate([p[k] for p in parts]))
        out.append(counts)
    return values, *out


def toxic_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The runs of toxic texts, a byte more at either end, whose grams are more frequent there; each once a text."""
    if not toxic:
        return []
    values, inside, held = occurrences(toxic)
    often = held >= PASSAGE_TEXTS
    values, inside = values[often], inside[often]
    _, outside, _ = occurrences(ordinary, values)
    good = values[inside / len(toxic) >= PASSAGE_RATIO * (outside + 1) / max(1, len(ordinary))]
    out = []
    for t in toxic if len(good) else []:
        g = grams(t)
        at = np.searchsorted(good, g)
        at[at == len(good)] = 0
        hits = np.flatnonzero(good[at] == g)
        if len(hits):
            out += sorted({t[max(0, run[0] - 1) : run[-1] + GRAM + 1] for run in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)})
    return out


def toxic_strings(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """What zstandard's trainer finds in the toxic passages, a multiple of FILL; distinct passages where there is too little to train on."""
    import zstandard

    samples = [p for p in toxic_passages(toxic, ordinary) if len(p) >= 8]
    try:
        found = zstandard.train_dictionary(TOXIC_BYTES, samples, k=16, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        found = b"".join(dict.fromkeys(samples))[:TOXIC_BYTES]
    return found


def aligned(segments: bytes) -> bytes:
    """The segments at each remainder of FILL, and the whole a multiple of it.

    zstandard's fast strategies enter every third position of a dictionary only, so a segment must be there at each
    offset to be found. They come last, where later entries of the tables do not replace theirs.
    """
    out = b""
    for shift in range(FILL):
        out += b" " * ((shift - len(out)) % FILL) + segments
    return out + b" " * (-len(out) % FILL)


def base_strings(ordinary: list[bytes]) -> bytes:
    """What zstandard's trainer finds in ordinary text; the text itself where there is too little to train on."""
    import zstandard

    samples = [t[i : i + 256] for t in ordinary for i in range(0, len(t), 256)]
    try:
        return zstandard.train_dictionary(BASE_BYTES, samples, k=48, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ordinary)[:BASE_BYTES]


@dataclass
class ToxicityModel:
    base: bytes = b""
    trained: bytes = b""
    segments: bytes = b""
    weights: list[float] = field(default_factory=list)

    def compressors(self):
        """Of the ordinary, the narrow toxic and the broad toxic dictionary."""
        import zstandard

        contents = [self.base, self.base + aligned(self.segments), self.base + aligned(self.trained)]
        reach = max(REACH, *map(len, contents))
        for content in contents:
            if len(content) < 8:
                content += b" " * 8
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=WINDOW, dict_size=reach, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
            )
            own.precompute_compress(compression_params=params)
            yield zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress

    @staticmethod
    def features(data: bytes, ordinary, *toxic) -> list[float]:
        saved, most, net, windows = [Counter() for _ in toxic], [0] * len(toxic), [0] * len(toxic), 0
        for i in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE):
            window = data[i : i + WINDOW]
            plain, windows = len(ordinary(window)), windows + 1
            for k, compress in enumerate(toxic):
                won = plain - len(compress(window))
                net[k] += won
                if won > 0:
                    saved[k][min(won, SAVED[-1])] += 1
                    most[k] = max(most[k], won)
        out, size = [], np.log1p(windows)
        for own, top, all_in_all in zip(saved, most, net):
            out += [3 * all_in_all / windows, np.sign(all_in_all) * np.log1p(abs(all_in_all)), min(top, 12) / 4]
            total = 0
            for t in reversed(SAVED):
                total += own[t]
                out.append(np.log1p(total))
                if t in SHARES:
                    out += [10 * total / windows, np.log1p(total) / size, max(0.0, np.log1p(total) - np.log1p(CHANCE * windows))]
        return [float(x) for x in [*out, size / 4]]

    def scorer(self):
        compressors = list(self.compressors())
        weights = self.weights

        def score(text: str | None) -> float:
            if len(weights) == 1:
                return weights[0]
            x = self.features(folded(text), *compressors)
            z = sum(a * b for a, b in zip(x, weights)) + weights[-1]
            return float(1 / (1 + np.exp(-min(30, max(-30, z)))))

        return score


def fit(sample: list[tuple[int, str]]) -> ToxicityModel:
    """Dictionaries from two thirds of the sample, thresholds and weights from the rest."""
    if len({y for y, _ in sample}) < 2:
        return ToxicityModel(weights=[float(np.mean([y for y, _ in sample])) if sample else 0.0])
    first = [(y, folded(t)) for i, (y, t) in enumerate(sample) if i % 3]
    rest = [(y, folded(t)) for i, (y, t) in enumerate(sample) if not i % 3]
    toxic = without_copies([t for y, t in first if y == 1])
    ordinary = without_copies([t for y, t in first if y == 0])
    model = ToxicityModel(base_strings(ordinary))
    give_back()  # of the driver's memory, step by step
    model.trained = toxic_strings(toxic, ordinary)
    give_back()
    model.segments = toxic_segments(toxic, ordinary)
    give_back()
    compressors = list(model.compressors())
    y = np.array([y for y, _ in rest], float)
    x = np.array([model.features(t, *compressors) for _, t in rest])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model.weights = fit_logistic(x, y, np.where(y == 1, np.sqrt((1 - share) / share), 1.0), ridge=1.0).tolist()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with a score column: 0 to 1, higher the likelier toxic. No shuffle."""
    score = free_name(docs, score)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        of = shared.value.scorer()
        for batch in batches:
            scores = pa.array([of(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def held_out(id_col):
    return fold_of(id_col, 5) == 0


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    return fit(labelled_sample(docs, labels, "toxic", held_out, per_class=per_class))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
