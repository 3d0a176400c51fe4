"""Packing of token ids into windows by best-fit decreasing.

Each task tokenizes its own documents and packs them, some millions of tokens at a time, so nothing is shuffled and no
window spans two tasks: a task that runs again gives its windows again. A document longer than a window is first cut into
full windows; what is left of it is an item. Items are placed longest first, each in the open window with the least room
that still holds it, which a segment tree over the remaining capacities finds. Windows that are left with room of
least_cut tokens or more are then filled: the emptiest ones are poured into the others, the pieces being cut where they
must. The one window that remains of a block is cut into sequences whose lengths are powers of two, which need no padding.
So a window is padded by less than least_cut tokens, whatever the lengths and however the documents are partitioned.

Defined results: a null or empty text is the end id alone. Rows are documents of their own, also those that repeat a
doc_id or have none. An empty table gives no pieces. Extra columns are not carried along, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.shared import lean, quoted

WIDTH, END_ID, LEAST_CUT = 2048, 1, 16
BLOCK_TOKENS = 6_000_000
CACHE_WORDS = 600_000
JOINED_BYTES = 1 << 13
MARKS, LINE = ".,;:!?%#*$&", "\x01"
#: Between a character and the blank behind it no token of a byte-level tokenizer reaches across.
BEFORE_BLANKS = re.compile(r"(?<=\S)(?=[ \n])")


class ByteEncoder:
    """A byte-level tokenizer whose ids of words are remembered, each with the blank in front of it.

    A run of blanks belongs to the word behind it, but for its last blank; so texts may be cut wherever a blank follows
    another character, and the parts' ids are those of the text. Likewise between a letter and a mark. Added tokens are
    left to the tokenizer with the word that holds them. When the memory is full, further words are encoded where they
    occur; after as many of them as it holds four times over it is emptied.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # threads of its own would vie with the other tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.type = "H" if max(*vocabulary.values(), end_id) < 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.type == "H" else "<u4")
        self.end = array(self.type, [end_id]).tobytes()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # words with a space in front; LINE in a word stands for a line end instead
        self.tails: dict[str, bytes] = {}  # runs of marks behind a letter
        self.passed = 0

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [array(self.type, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words with a space in front, many at a time: each word's begin with the one that has the space."""
        out, group, size = {}, [], 0
        for word in [*words, None]:
            if group and (word is None or size > JOINED_BYTES):
                (data,) = self.ids_of([" " + " ".join(group)])
                step = self.dtype.itemsize
                starts = (np.flatnonzero(self.opens[np.frombuffer(data, self.dtype)]) * step).tolist()
                if len(starts) == len(group):
                    out.update((w, data[a:b]) for w, a, b in zip(group, starts, [*starts[1:], len(data)]))
                else:  # an unusual vocabulary: one by one
                    out.update(zip(group, self.ids_of([" " + w for w in group])))
                group, size = [], 0
            if word is not None:
                group.append(word)
                size += len(word)
        return out

    def _learned(self, words: set[str]) -> dict[str, bytes]:
        """The ids of new words, by their cores and the marks behind them; they are remembered if there is room."""
        known, parts, alone = self.known, {}, []
        for word in words:
            if LINE in word or any(a in word for a in self.added):
                alone.append(word)
                continue
            core = word.rstrip(MARKS)
            parts[word] = core if core[-1:].isalpha() else word
        new = self._joined([c for c in set(parts.values()) if c not in known])
        out = dict(zip(alone, self.ids_of([w.replace(LINE, "\n") if LINE in w else " " + w for w in alone])))
        tails = list({w[len(c) :] for w, c in parts.items()} - self.tails.keys())
        if len(self.tails) > 1 << 16:
            self.tails, tails = {}, list({w[len(c) :] for w, c in parts.items()})
        self.tails.update(zip(tails, self.ids_of(tails)))
        for word, core in parts.items():
            own = new[core] if core in new else known[core]
            out[word] = own if core == word else own + self.tails[word[len(core) :]]
        if len(known) + len(out) + len(new) <= CACHE_WORDS:
            known.update(new)
            known.update(out)
        else:
            self.passed += len(out)
            if self.passed > 4 * CACHE_WORDS:
                known.clear()
                self.passed = 0
        return out

    def encoded(self, text: str | None) -> bytes:
        """The ids of the text and the end id, little-endian."""
        if not text:
            return self.end
        first, blank, rest = text.replace("\n", " " + LINE).partition(" ")
        words = rest.split()
        if rest.count(" ") + 1 != len(words) or len(rest) != len(words) - 1 + sum(map(len, words)) or LINE in text or LINE in words or not first or first != first.strip():
            return b"".join(self.ids_of(BEFORE_BLANKS.split(text))) + self.end  # other blanks, or more than one in a place
        got = list(map(self.known.get, words))
        if None in got:
            new = self._learned({w for w, ids in zip(words, got) if ids is None})
            got = [ids if ids is not None else new[w] for w, ids in zip(words, got)]
        return self.ids_of([first])[0] + b"".join(got) + self.end


class Room:
    """Open windows by the room they have left; a segment tree over the capacities finds the tightest that fits."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.held = [0] * (2 * self.size)  # open windows below each node
        self.windows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its room) of an open window with the least room of need or more, which is then no longer open."""
        held, node = self.held, self.size + need
        if not held[node]:
            while node > 1 and (node & 1 or not held[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if held[2 * node] else 2 * node + 1
        room = node - self.size
        self._count(room, -1)
        return self.windows[room].pop(), room

    def _count(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.held[node] += by
            node >>= 1


def best_fit(lengths: list[int], width: int = WIDTH, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold each token of each item once.

    A sequence is shorter than width by less than least_cut, or its length is a power of two.
    """
    done, windows, room = [], [], Room(width)
    for item, n in enumerate(lengths):
        done += [[(item, at, width)] for at in range(0, n - width + 1, width)]
    for item in sorted((i for i, n in enumerate(lengths) if n % width), key=lambda i: -(lengths[i] % width)):
        need = lengths[item] % width
        window, free = room.take(need) or (len(windows), width)
        if window == len(windows):
            windows.append([])
        windows[window].append((item, lengths[item] - need, need))
        if free > need:
            room.put(free - need, window)
    held = [sum(p[2] for p in w) for w in windows]
    done += [w for w, n in zip(windows, held) if width - n < least_cut]
    loose = sorted((i for i, n in enumerate(held) if width - n >= least_cut), key=lambda i: held[i])
    low, high, poured = 0, len(loose) - 1, []
    while low <= high:  # the emptiest windows are poured into the fullest
        target = windows[loose[high]]
        left = width - held[loose[high]]
        while left and (poured or low < high):
            if not poured:
                poured, low = windows[loose[low]], low + 1
            item, start, n = poured.pop()
            target.append((item, start, min(n, left)))
            if n > left:
                poured.append((item, start + left, n - left))
            left -= min(n, left)
        if left:
            return done + powers_of_two(target)
        done.append(target)
        high -= 1
    return done + powers_of_two(poured)


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces, cut into sequences whose lengths are powers of two, the longest first."""
    out, pieces = [], pieces[::-1]
    total = sum(p[2] for p in pieces)
    for bit in reversed(range(total.bit_length())):
        left = total & (1 << bit)
        if left:
            out.append([])
        while left:
            item, start, n = pieces.pop()
            out[-1].append((item, start, min(n, left)))
            if n > left:
                pieces.append((item, start + left, n - left))
            left -= min(n, left)
    return out


_encoders: dict = {}


def encoder_of(path: str, end_id: int) -> ByteEncoder:
    """One encoder for each worker process, so that the words it knows outlast a task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = ByteEncoder(path, end_id)
    return _encoders[path, end_id]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    width: int = WIDTH,
    end_id: int = END_ID,
    least_cut: int = LEAST_CUT,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids if asked for.

    tokenizer is the path of a byte-level tokenizers file, which is read on the executors. Sequence ids are unique, not
    gapless: the task's number and a number within it. The pieces of a sequence are next to each other, in its order.
    """
    import pyarrow as pa

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{n} long" for n in names) + (", ids array<int>" if with_ids else "")

    def packed(ids, bodies, first):
        """Batches of the pieces of a block, and the number of its sequences."""
        sizes = [len(b) for b in bodies]
        sequences = best_fit(sizes, width, least_cut)
        out, extra, weight = [], [], 0
        for number, pieces in enumerate(sequences, first):
            offset = 0
            for item, start, n in pieces:
                own = bodies[item][start : start + n].astype("<u4")
                out.append((ids[item], start, n, zlib.crc32(own.tobytes()), sizes[item], number, offset))
                if with_ids:
                    extra.append(own.astype("i4"))
                offset += n
            weight += 8 * len(names) * len(pieces) + 4 * with_ids * offset
            if weight > 4 << 20 or number == first + len(sequences) - 1:
                columns = [pa.array(c, pa.int64()) for c in zip(*out)] + ([pa.array(extra, pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)
                out, extra, weight = [], [], 0
        yield len(sequences)

    def pack(batches):
        encoder = encoder_of(tokenizer, end_id)
        first = TaskContext.get().partitionId() << 40
        ids, bodies, tokens = [], [], 0

        def block():
            nonlocal ids, bodies, tokens, first
            for x in packed(ids, bodies, first):
                if isinstance(x, int):
                    first += x
                else:
                    yield x
            ids, bodies, tokens = [], [], 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = np.frombuffer(encoder.encoded(text.as_py()), encoder.dtype)
                ids.append(doc)
                bodies.append(body)
                tokens += len(body)
                if tokens >= block_tokens:
                    yield from block()
        if ids:
            yield from block()

    return rows.mapInArrow(lean(pack), schema)


def padded_sequences(pieces: DataFrame, width: int = WIDTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, input_ids, doc_ids, piece_lengths) of the pieces of pack_documents with their ids.

    Sequences of other lengths than powers of two are padded to width with pad_id.
    """
    got = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("own"))
    ids, n = F.flatten("own.ids"), F.size(F.flatten("own.ids"))
    whole = n.bitwiseAND(n - 1) == 0
    return got.select(
        "sequence_id",
        F.when(whole, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), width - n)))).alias("input_ids"),
        F.col("own.doc_id").alias("doc_ids"),
        F.col("own.length").alias("piece_lengths"),
    )


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
