"""Token ids in length-delimited binary records, with a separate offset index.

Documents are range-partitioned and sorted by id, tokenized, and framed one record each: the payload's length (8 bytes,
little-endian), a masked checksum of those 8 bytes, the payload, a masked checksum of the payload. A payload is the doc_id
(8 bytes, signed), the width of an id in bytes (1) and the ids. A record whose doc_id is null has the flag 128 set in the
width. The index file has a fixed-size entry for each record: its offset, its length, its first id's place in the shard
and its number of ids, so a reader can fetch records in any order. Checksums are CRC-32, rotated right by 15 bits plus
0xA282EAD8 ("masked"), so that a checksum of data that holds checksums stays sound.

Tasks write under temporary names and rename; the manifest lists the files of the tasks that counted, so repeated or lost
tasks leave nothing that a reader would see.

Defined results: null and empty texts have the end id only; a null doc_id comes first in the order; rows that repeat a
doc_id are records of their own, ordered by text; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from functools import cache
from itertools import accumulate, chain, pairwise
from unicodedata import is_normalized

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.shared import file_system, lean, partitions_for, quoted, scratch
from loomery.operators.bytepairs import slices

END_ID = 2
CACHE_WORDS = 900_000
MARKS = ".,;:!?"
LAST_COMMON = "\u024f"  # up to it all versions of Unicode agree on letters and their case
BPE_SETTINGS = ["unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"]
ENCODED_BYTES = 8 << 20
JOINED_WORDS = 256
TYPE_OF = {2: "H", 4: "I"}
INDEX_ENTRY = "<QQQQ"
READ_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframed(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, offset of the next record); raises ValueError where a checksum differs or data end too early."""
    head = data[at : at + 12]
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError(f"damaged length at offset {at}")
    end = at + 12 + struct.unpack("<Q", head[:8])[0]
    payload, check = data[at + 12 : end], data[end : end + 4]
    if len(check) < 4 or struct.unpack("<I", check)[0] != masked(payload):
        raise ValueError(f"damaged record at offset {at}")
    return payload, end + 4


def payload_of(doc_id: int | None, body: bytes, width: int) -> bytes:
    return struct.pack("<qB", doc_id or 0, width | (128 if doc_id is None else 0)) + body


def read_payload(payload: bytes):
    """(doc_id, ids as unsigned 32-bit numbers)"""
    import numpy as np

    doc_id, width = struct.unpack_from("<qB", payload)
    return None if width & 128 else doc_id, np.frombuffer(payload, f"<u{width & 127}", offset=9).astype("<u4")


class WordEncoder:
    """A tokenizer that drops white space between words, with the ids of words kept as bytes.

    No token of such a tokenizer crosses white space, so a text's ids are those of its blank-separated words in order.
    Only ASCII blanks are split at; anything else is left to the tokenizer, which lower-cases. A word that ends in a run of
    common marks after an ASCII letter or digit is its core and that run, and both are kept with A-Z lower-cased. Added
    tokens are matched before the tokenizer lower-cases, so a word that holds one in any case is handed over as it is.
    Texts are split, and their different words told apart, an Arrow array at a time. The cache is emptied when it is full.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # threads of its own would vie with the other tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if max(self.vocabulary, end_id + 1) <= 1 << 16 else 4
        self.end = end_id.to_bytes(self.width, "little")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = {i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)}
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = plain_words(path)
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        """Puts the ids of different new words, lower-cased where they hold no added token, into the cache."""
        known = self.known
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        texts = {w: w.decode("utf-8", "surrogatepass") for w in words}
        plain = [w for w, t in texts.items() if t.isalpha() and t == t.lower() and is_normalized("NFC", t)]
        common = [w for w in plain if w.isascii() or max(texts[w]) <= LAST_COMMON]
        for own, tokenizer in ((common, self.plain), ([w for w in plain if not w.isascii() and max(texts[w]) > LAST_COMMON], self.tokenizer)):
            for i in range(0, len(own), JOINED_WORDS):
                self._learn_joined(own[i : i + JOINED_WORDS], texts, tokenizer)
        rest = [w for w in words if w not in known]
        for word, got in zip(rest, self.tokenizer.encode_batch_fast([texts[w] for w in rest], add_special_tokens=False)):
            known[word] = array(TYPE_OF[self.width], got.ids).tobytes()

    def _learn_joined(self, words: list[bytes], texts: dict[bytes, str], tokenizer) -> None:
        """Learns words of letters as one text: the ids of each end with the one id that closes a word."""
        ids = tokenizer.encode_batch_fast([" ".join([texts[w] for w in words])], add_special_tokens=False)[0].ids
        closed = [i + 1 for i, x in enumerate(ids) if x in self.closing]
        if len(closed) == len(words) and closed[-1] == len(ids):
            data, start = array(TYPE_OF[self.width], ids).tobytes(), 0
            for word, end in zip(words, closed):
                self.known[word] = data[start * self.width : end * self.width]
                start = end

    def _ids_of(self, words) -> list[bytes]:
        """The ids of each of an Arrow array of different words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        small = pc.ascii_lower(words)
        cores = pc.binary_length(pc.ascii_rtrim(small, characters=MARKS)).to_numpy()
        parts, tails = small.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), {}
        for i in ((cores > 0) & (cores < pc.binary_length(small).to_numpy())).nonzero()[0].tolist():
            word, n = parts[i], cores[i]
            if word[n - 1 : n].isalnum():
                parts[i], tails[i] = word[:n], word[n:]
        for token in self.added:
            for i in pc.indices_nonzero(pc.match_substring(small, token)).to_pylist():
                parts[i] = words[i].as_py().encode()
                tails.pop(i, None)
        got = list(map(self.known.get, parts))
        ends = {tail: self.known.get(tail) for tail in tails.values()}
        new = [part for part, ids in zip(parts, got) if ids is None] + [tail for tail, ids in ends.items() if ids is None]
        if new:
            self.learn(list(dict.fromkeys(new)))  # which may forget others, but not these
            got = [ids if ids is not None else self.known[part] for part, ids in zip(parts, got)]
            ends = {tail: ids if ids is not None else self.known[tail] for tail, ids in ends.items()}
        for i, tail in tails.items():
            got[i] += ends[tail]
        return got

    def encoded_all(self, texts) -> list[bytes]:
        """For each text of an Arrow array its ids and the end id, little-endian, width bytes each."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = split.flatten().dictionary_encode()
        ids = pa.array(self._ids_of(coded.dictionary), pa.large_binary()).take(coded.indices)
        if not len(ids):
            return [self.end] * len(texts)
        data, bounds = memoryview(ids.buffers()[2]), memoryview(ids.buffers()[1]).cast("q")
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy().tolist()
        cuts = [bounds[i] for i in accumulate(counts, initial=0)]
        return [b"".join((data[a:b], self.end)) for a, b in pairwise(cuts)]

    def encoded(self, text: str | None) -> bytes:
        """The ids of the text and the end id, little-endian, width bytes each."""
        import pyarrow as pa

        return self.encoded_all(pa.array([text], pa.string()))[0]

    def ids(self, text: str | None) -> list[int]:
        return array(TYPE_OF[self.width], self.encoded(text)).tolist()[:-1]


@cache
def plain_words(path: str):
    """The tokenizer of a file for words that its normalizer and splitter leave as they are, set apart by blanks.

    Its model is the file's, without a cache of words, as each word is looked up once. For other models it is the file's tokenizer.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE":
        return Tokenizer.from_file(path)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    told = {k: model[k] for k in BPE_SETTINGS if model.get(k) is not None}
    out = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **told))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


_encoders: dict = {}


def encoder_of(path: str, end_id: int) -> WordEncoder:
    """One encoder for each worker process, so that the words it knows outlast a task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def write_records(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None
) -> str:
    """Writes docs to path in ascending id order and returns the path of the manifest.

    tokenizer is the path of a tokenizers file, which is read on the executors.
    """
    spark = docs.sparkSession
    file_system(path)[0].create_dir(file_system(path)[1], recursive=True)
    rows = (
        docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(quoted(text_col)).alias("body"))
        .repartitionByRange(shards or partitions_for(spark), F.col("doc").asc_nulls_first())
        .sortWithinPartitions(F.col("doc").asc_nulls_first(), F.col("body").asc_nulls_first())
        .withColumn("shard", F.spark_partition_id())
    )

    def write(batches):
        import pyarrow as pa

        encoder = encoder_of(tokenizer, end_id)
        width = encoder.width
        fs, folder = file_system(path)
        shard, data, index, name = None, None, None, ""
        offset = tokens = records = 0
        first = last = None
        for batch in batches:
            bodies = chain.from_iterable(map(encoder.encoded_all, slices(batch.column(1), ENCODED_BYTES)))
            for doc, ids, part in zip(batch.column(0).to_pylist(), bodies, batch.column(2).to_pylist()):
                if data is None:
                    shard, name = part, f"shard-{part:06d}-{uuid.uuid4().hex[:12]}"
                    data = fs.open_output_stream(f"{folder}/.{name}.rec.tmp")
                    index = fs.open_output_stream(f"{folder}/.{name}.idx.tmp")
                    first = doc
                count = len(ids) // width
                record = framed(payload_of(doc, ids, width))
                data.write(record)
                index.write(struct.pack(INDEX_ENTRY, offset, len(record), tokens, count))
                offset, tokens, records, last = offset + len(record), tokens + count, records + 1, doc
        if data is not None:
            data.close()
            index.close()
            for kind in ("rec", "idx"):
                fs.move(f"{folder}/.{name}.{kind}.tmp", f"{folder}/{name}.{kind}")
            values = [[shard], [name], [records], [tokens], [offset], [first], [last]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

    import pyarrow as pa

    names = ["shard", "name", "records", "tokens", "bytes", "first_id", "last_id"]
    types = [pa.int32(), pa.string(), *[pa.int64()] * 5]
    schema = "shard int, name string, records long, tokens long, bytes long, first_id long, last_id long"
    done = sorted(rows.mapInArrow(lean(write), schema).collect(), key=lambda r: r.shard)  # a row for each shard
    starts = [0, *accumulate(r.tokens for r in done)]
    manifest = {"end_id": end_id, "shards": [r.asDict() | {"start": s} for r, s in zip(done, starts)], "tokens": starts[-1]}
    fs, folder = file_system(path)
    with fs.open_output_stream(f"{folder}/.manifest.json.tmp") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{folder}/.manifest.json.tmp", f"{folder}/manifest.json")
    return f"{path}/manifest.json"


def read_manifest(path: str) -> dict:
    fs, folder = file_system(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row a record: doc_id, start (ids before it), n_tokens, ids_crc32, and the ids if asked for.

    Shards are read side by side, each record by its index entry; a wrong checksum fails the read.
    """
    shards = [(s["name"], s["start"]) for s in read_manifest(path)["shards"]]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    frame = spark.createDataFrame(shards, "name string, start long")
    if not shards:
        return spark.createDataFrame([], schema)
    frame = frame.repartition(len(shards), "name")

    def rows_of(fs, folder, name, start):
        with fs.open_input_stream(f"{folder}/{name}.idx") as f:
            entries = f.read()
        at = 0
        with fs.open_input_stream(f"{folder}/{name}.rec", buffer_size=READ_BYTES) as f:  # the records stand in the index's order
            for offset, size, before, count in struct.iter_unpack(INDEX_ENTRY, entries):
                doc, ids = read_payload(unframed(f.read(size))[0])
                if len(ids) != count or offset != at:
                    raise ValueError(f"the index and the record at {offset} of {name} differ")
                at += size
                yield (doc, start + before, count, zlib.crc32(ids.tobytes()), *([ids.astype("i4")] if with_ids else []))

    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
        fields = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)]
        fs, folder = file_system(path)
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows_of(fs, folder, name, start):
                    held.append(row)
                    weight += 32 + (4 * row[2] if with_ids else 0)
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=fields)
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=fields)

    return frame.mapInArrow(lean(read), schema)


def read_some(path: str, shard: str, places: list[int]) -> list[tuple]:
    """(doc_id, ids) of some records of a shard, by their places in its index and in any order: for shuffled reads."""
    fs, folder = file_system(path)
    size = struct.calcsize(INDEX_ENTRY)
    out = []
    with fs.open_input_file(f"{folder}/{shard}.idx") as index, fs.open_input_file(f"{folder}/{shard}.rec") as data:
        for place in places:
            offset, length, _, _ = struct.unpack(INDEX_ENTRY, index.read_at(size, place * size))
            out.append(read_payload(unframed(data.read_at(length, offset))[0]))
    return out


def op4_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch(spark, "records")
    write_records(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_records(spark, path, with_ids=False)
