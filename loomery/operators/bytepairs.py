"""Byte-pair encoding in flat arrays: an Arrow batch is split, merged and decoded as a whole, without a loop over rows.

The text of a batch, or of each SLICE_BYTES of it, is one array of characters. Its words begin where classes of characters
change, by the rules of byte-level tokenizers; each different word is merged once a slice. Merging runs over the ids of all words at a time: pairs are packed into
one number and looked up in the merge table by a hash, and in each round every word merges its pair of the lowest rank,
wherever it occurs; only pairs that a merge has made are looked up again. A merge makes pairs of higher ranks only, so this
is the same as one merge after the other.

Defined results: a null text gives null, an empty one no ids. Added tokens of the file are ordinary text here. Decoding fails
on an id that the table has not, and gives bytes, since a cut sequence may end within a character.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
#: What an apostrophe takes with it.
SHORT = ["s", "t", "m", "d", "re", "ve", "ll"]
# End of fixed values.
NO_RANK = np.iinfo(np.int64).max
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Of values of a batch that are worked on at a time: the arrays beside them are some 40 times as large.
SLICE_BYTES = 2 << 20
SLOT_BITS = 19


@cache
def classes() -> np.ndarray:
    """The class of every character, by its category; the separators of ASCII are no blanks here."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    blank = [i for i in range(0x3001) if chr(i).isspace() and not 0x1C <= i <= 0x1F]
    out[blank] = BLANK
    return out


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the files: itself where it prints, else those from 256 on, in order."""
    printing = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


def starts_of_words(points: np.ndarray, firsts: np.ndarray, digits_alone: bool = False) -> np.ndarray:
    """Where words begin in an array of code points whose texts begin at firsts (sorted, of texts that are not empty).

    A word is a run of letters, of numbers or of other marks, with the space in front of it, or a run of blanks without
    the last one where something follows. An apostrophe at a word's beginning takes the endings of SHORT with it. With
    digits_alone each number is a word of its own and takes no space.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start[:n])
    ends = np.r_[runs[1:], n]
    if digits_alone:
        start[:n] |= kind == NUMBER
    blanks = (kind[runs] == BLANK) & ~first[ends]
    last = ends[blanks] - 1
    start[last] = True
    joins = points[last] == ord(" ")
    if digits_alone:
        joins &= kind[last + 1] != NUMBER
    start[last[joins] + 1] = False
    marks = np.flatnonzero((points == ord("'")) & start[:n])
    free = np.ones(len(marks), bool)
    for ending in SHORT:
        fits, size = free & (marks + len(ending) < n), len(ending)
        for i, c in enumerate(ending, 1):
            at = np.minimum(marks + i, n - 1)
            fits &= (points[at] == ord(c)) & ~first[at]
        hit = marks[fits]
        start[hit + 1] = False
        after = hit + 1 + size
        start[after] |= kind[np.minimum(after, n - 1)] == LETTER
        free &= ~fits
    return np.flatnonzero(start[:n])


def split_texts(texts, digits_alone: bool = False):
    """(words, text of each word): all words of an Arrow string array, as bytes and in order."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # a byte for each character
    points = data if len(heads) == len(data) else np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    filled = np.flatnonzero(np.diff(offsets) > 0)
    starts = starts_of_words(points, np.searchsorted(heads, offsets[filled]), digits_alone)
    bounds = np.r_[heads[starts], len(data)].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())])
    return words, np.searchsorted(offsets, bounds[:-1], side="right") - 1


class BytePairs:
    """A vocabulary and its merges in sorted arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        self.tokens: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.seed = np.full(256, -1, np.int64)
        for c, b in letters.items():
            self.seed[b] = vocabulary.get(c, -1)
        packed = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(packed, kind="stable")
        self.keys, self.ranks = packed[order], order.astype(np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)[order]
        # places by slot, those of one slot in a chain; -1 ends it
        slots = self._slots(self.keys)
        self.slot, self.after = np.full(1 << SLOT_BITS, -1, np.int32), np.full(len(self.keys) + 1, -1, np.int32)
        for place, slot in enumerate(slots.tolist()):
            self.after[place], self.slot[slot] = self.slot[slot], place

    @classmethod
    def load(cls, path: str) -> "BytePairs":
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    @staticmethod
    def _slots(pairs: np.ndarray) -> np.ndarray:
        h = pairs.astype(np.uint64)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def found(self, pairs: np.ndarray) -> np.ndarray:
        """The place of each packed pair in the table, or -1."""
        if not len(self.keys):
            return np.full(len(pairs), -1)
        at = self.slot[self._slots(pairs)]
        other = np.flatnonzero((at >= 0) & (self.keys[at] != pairs))
        while len(other):
            at[other] = self.after[at[other]]
            other = other[(at[other] >= 0) & (self.keys[at[other]] != pairs[other])]
        return at

    def merged(self, ids: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, words) with all merges made; words tells, in rising order, which word each id is of."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        at, stale = np.full(len(ids), -1), np.ones(len(ids), bool)  # the place of each id's pair with the next; not looked up yet
        while len(ids):
            same = words[1:] == words[:-1]
            at[stale] = -1
            places = np.flatnonzero(stale[:-1] & same)
            at[places] = self.found(ids[places] << 32 | ids[places + 1])
            rank = np.where(at >= 0, self.ranks[at], NO_RANK) if len(self.ranks) else np.full(len(ids), NO_RANK)
            heads = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[heads, len(ids)])
            best = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            settled = best == NO_RANK
            if settled.any():
                done.append((ids[settled], words[settled]))
            take = (rank == best) & ~settled
            # of a run of equal pairs that overlap every second one goes first
            run = np.flatnonzero(take & ~np.r_[False, take[:-1]])
            place = np.arange(len(ids))
            begun = place[run][np.maximum(np.cumsum(take & ~np.r_[False, take[:-1]]) - 1, 0)] if len(run) else place
            take &= (place - begun) % 2 == 0
            ids = np.where(take, self.made[at], ids) if take.any() else ids
            keep = ~np.r_[False, take[:-1]] & ~settled
            stale = (take | np.r_[take[1:], False])[keep]
            ids, words, at = ids[keep], words[keep], at[keep]
        if not done:
            return ids, words
        ids, words = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(words, kind="stable")
        return ids[order], words[order]

    def encoded(self, texts, digits_alone: bool = False):
        """An Arrow array of lists of ids for an array of texts."""
        import pyarrow as pa

        words, owner = split_texts(texts, digits_alone)
        coded = words.dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy()
        sizes = np.diff(np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1])
        flat = np.frombuffer(distinct.buffers()[2], np.uint8)[: sizes.sum()] if len(distinct) else np.zeros(0, np.uint8)
        ids, of = self.merged(self.seed[flat], np.repeat(np.arange(len(distinct)), sizes))
        if (ids < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        counts = np.bincount(of, minlength=len(distinct)) if len(distinct) else np.zeros(0, np.int64)
        own = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
        flat_ids = own.take(pa.array(index)).flatten() if len(index) else pa.array([], pa.int32())
        per_text = np.bincount(owner, weights=counts[index], minlength=len(texts)).astype(np.int64) if len(index) else np.zeros(len(texts), np.int64)
        bounds = pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32))
        return pa.ListArray.from_arrays(bounds, flat_ids, mask=texts.is_null())

    def decoded(self, lists):
        """An Arrow array of the bytes of lists of ids; an id that is not in the table is an error."""
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = lists.flatten()
        ids = flat.to_numpy(zero_copy_only=False)
        if flat.null_count or (len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens))):
            raise ValueError("an id is not in the vocabulary")
        found = pa.array(self.tokens, pa.large_binary()).take(flat)
        if found.null_count:
            raise ValueError("an id is not in the vocabulary")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, np.int64)
        bounds = ends[np.r_[0, np.cumsum(sizes)]]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds), found.buffers()[2]])
        return pc.if_else(lists.is_null(), pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())


@cache
def loaded(path: str) -> BytePairs:
    """One table a worker process."""
    return BytePairs.load(path)


def slices(values, bound: int):
    """An Arrow array of strings or lists cut into runs of rows of at most bound bytes, a longer row alone; one run if it has no rows."""
    import pyarrow as pa

    wide = pa.types.is_large_string(values.type) or pa.types.is_large_list(values.type)
    ends = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    unit = 1 if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else 4
    at = 0
    while True:
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + bound // unit, side="right")) - 1)
        yield values.slice(at, min(to, len(values)) - at)
        at = to
        if at >= len(values):
            return


def bounded(run, kind: str):
    """run as a function of Arrow arrays, a slice at a time, in batches of BATCH_ROWS where the session has Spark's default.

    What a batch took goes back to the system, as workers live on and the allocator would keep the most they ever needed.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))

    def whole(values):
        import pyarrow as pa

        out = pa.concat_arrays([run(part) for part in slices(values, SLICE_BYTES)])
        trim()
        return out

    return F.arrow_udf(whole, kind)


def trim() -> None:
    """Returns the free parts of a worker's memory to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def words(text: Column, digits_alone: bool = False) -> Column:
    """The words of a text, as a byte-level tokenizer splits it; null for null."""

    def run(texts):
        import pyarrow as pa

        found, owner = split_texts(texts, digits_alone)
        bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), found.cast(pa.binary()).cast(pa.string()), mask=texts.is_null())

    return bounded(run, "array<string>")(text)


def encode(text: Column, path: str, digits_alone: bool = False) -> Column:
    """The ids of a text by a file of a byte-level vocabulary and its merges, which is read where the texts are."""
    return bounded(lambda texts: loaded(path).encoded(texts, digits_alone), "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes that ids stand for."""
    return bounded(lambda lists: loaded(path).decoded(lists), "binary")(ids)


def merge_table(spark: SparkSession, path: str) -> DataFrame:
    """(rank, packed, made): the merges of a file, each pair packed in one number, to be sorted by it."""
    table = loaded(path)
    rows = zip(table.ranks.tolist(), table.keys.tolist(), table.made.tolist())
    return spark.createDataFrame(list(rows), "rank long, packed long, made long")  # a vocabulary's size
