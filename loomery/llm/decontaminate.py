"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive benchmark words. For each length of pattern there is a block shift table (how far
the search may jump, by the last two words of the current window) and buckets of patterns by their closing block; a jump
of zero opens the bucket, and comparing all words confirms an occurrence. Texts are streamed in Arrow batches without any
shuffle. A benchmark beyond BLOCK_BYTES is searched in blocks of that size: a task holds HOLD_BYTES of texts, builds the tables
of one block after the other and scans what it holds with each, so a worker has the tables of one block at a time.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A document word inside any
occurrence is hit.

Defined results: null or empty texts have no words and hit nothing; benchmark rows with null text or null item_id take no
part; items that repeat a text are all reported, rows that repeat an item_id count as one item; repeated documents are
answered row by row; extra columns stay, and new columns whose names are taken get underscores in front.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.shared import free_name, lean, quoted

WINDOW_WORDS = 10
BLOCK_BYTES = 1 << 20  # about 120 MB of tables
HOLD_BYTES = 32 << 20
SLICE_ROWS = 512

#: Byte by byte: A-Z to a-z, other ASCII that is no letter or digit to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ") if text else []


def clean_words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


class WuManber:
    """Patterns of one length; search() gives the start of each occurrence and its pattern."""

    def __init__(self, patterns: dict[tuple[bytes, ...], int]):
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.longest_jump = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, number in patterns.items():
            for end in range(b, m + 1):
                block = pattern[end - b : end] if b == 2 else pattern[0]
                jump = m - end
                if jump < self.shift.get(block, self.longest_jump):
                    self.shift[block] = jump
            self.buckets.setdefault(block, {})[pattern] = number

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        m, jump_of, jump, n = self.length, self.shift.get, self.longest_jump, len(words)
        pairs = self.block == 2
        at = m - 1
        while at < n:
            block = (words[at - 1], words[at]) if pairs else words[at]
            step = jump_of(block, jump)
            if step:
                at += step
                continue
            number = self.buckets[block].get(tuple(words[at - m + 1 : at + 1]))
            if number is not None:
                yield at - m + 1, number
            at += 1


class Search:
    """All windows of some benchmark items, by length of window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW_WORDS):
        by_length: dict[int, dict] = {}
        self.owners: list[set[str]] = []
        for item, text in items:
            words = clean_words(text)
            size = min(window, len(words))
            if size:
                for i in range(len(words) - size + 1):
                    known = by_length.setdefault(size, {})
                    number = known.setdefault(tuple(words[i : i + size]), len(self.owners))
                    if number == len(self.owners):
                        self.owners.append(set())
                    self.owners[number].add(item)
        self.tables = [WuManber(p) for _, p in sorted(by_length.items())]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, end) of each occurrence, and the items that occur."""
        spans, items = [], set()
        for table in self.tables:
            for start, number in table.search(words):
                spans.append((start, start + table.length))
                items |= self.owners[number]
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """The items in lists of at most block_bytes of text each (or one item); only one list at a time is at the driver."""
    items = (
        benchmark.select(F.col(quoted(item_col)).cast("string").alias("item"), F.col(quoted(text_col)).alias("body"))
        .where("item is not null and body is not null and body <> ''")
        .distinct()
    )
    block: list[tuple[str, str]] = []
    size = 0
    for row in items.toLocalIterator():
        own = len(row.body.encode("utf-8", "surrogatepass"))
        if block and size + own > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, row.body))
        size += own
    if block:
        yield block


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    n_words: str = "n_words",
    spans: str = "hit_spans",
    items: str = "items",
) -> DataFrame:
    """docs with n_words, hit_spans (array of start and end, in words, disjoint) and items (sorted ids) added.

    The documents are read once, however many blocks of block_bytes the benchmark has.
    """
    n_words, spans, items = (free_name(docs, c) for c in (n_words, spans, items))
    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = (
        docs.withColumn(n_words, F.lit(0).cast("long"))
        .withColumn(spans, F.array().cast(T.ArrayType(pair)))
        .withColumn(items, F.array().cast("array<string>"))
    )
    sc = docs.sparkSession.sparkContext
    text_at = docs.columns.index(text_col)
    blocks = [sc.broadcast(b) for b in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)] or [sc.broadcast([])]
    return _scanned(out, blocks, text_at, window)


_built: dict = {}


def _search_of(run: str, block, window: int) -> Search:
    """One search for each worker process and run, so that its tables outlast a task."""
    if run not in _built:
        _built.clear()
        _built[run] = Search(block.value, window)
    return _built[run]


def _scanned(frame: DataFrame, blocks: list, text_at: int, window: int) -> DataFrame:
    run_id = uuid.uuid4().hex

    def found_in(texts, searches):
        """(number of words, spans, items) of each text."""
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        counts = [0] * len(texts)
        for search in searches:
            for i, text in enumerate(texts):
                words = clean_words(text)
                counts[i] = len(words)
                more, own = search.scan(words)
                spans[i] += more
                items[i] |= own
        return counts, spans, items

    def answered(held, searches):
        import pyarrow as pa

        texts = [t for batch in held for t in batch.column(text_at).to_pylist()]
        counts, spans, items = found_in(texts, searches)
        at = 0
        for batch in held:
            part = slice(at, at := at + batch.num_rows)
            arrays = batch.columns[:-3] + [
                pa.array(counts[part], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in merged(s)] for s in spans[part]], batch.schema.types[-2]),
                pa.array([sorted(x) for x in items[part]], batch.schema.types[-1]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                held.append(batch.slice(i, SLICE_ROWS))
                size += held[-1].nbytes
                if len(blocks) == 1 or size >= HOLD_BYTES:
                    yield from answered(held, searches())
                    held, size = [], 0
        if held:
            yield from answered(held, searches())

    def searches():
        if len(blocks) == 1:
            yield _search_of(run_id, blocks[0], window)
        else:
            for block in blocks:
                yield Search(block.value, window)

    return frame.mapInArrow(lean(scan), frame.schema)


def n_hit(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = n_hit(F.col("hit_spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _sql_words(table: str, key: str) -> str:
    return (
        f"select {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        f"'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table}"
    )


OP8_SQL = f"""
with d as ({_sql_words("documents", "doc_id")}),
b as ({_sql_words("benchmark", "cast(item_id as varchar) as item")}),
pat as (
  select item, least(10, len(w)) as m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where item is not null and len(w) > 0)
),
lengths as (select distinct m from pat),
pos as (
  select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') as win
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, lengths where len(w) >= m)
),
occ as (select doc_id, item, i, pos.m from pos join pat on pos.win = pat.win and pos.m = pat.m),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from occ) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits on d.doc_id = hits.doc_id left join its on d.doc_id = its.doc_id
"""
