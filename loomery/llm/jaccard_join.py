"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by T-occurrence search.

A document with n shingles and a partner must share at least T = ceil(t * n) of them. DivideSkip sets the T - 1 longest
inverted lists of a document aside: a partner must then occur on one of the n - T + 1 short lists, which are merged, and
the long lists are only probed, by binary search, for the partners found.

Spread over a cluster it goes as follows. A counting sketch of fixed size over all shingles orders them by frequency; the
n - T + 1 rarest of a document are its short lists. Documents with equal sets are one class from here on. Short lists
that classes share tie them into families, outside which no link can be, by those pairs whose sizes and parities allow a
link: of small lists all pairs are made, a large one is searched by parities in a task (in blocks beyond LIST_BLOCK), which
gives no more ties than there are classes. A set has as many parities as shingles or half of them, at least PARITY_BITS:
with fewer, chance meetings of long documents would tie a large part of the table into one family.
A family is searched in one task, with inverted lists of its own: the short lists of a set are merged by a heap, the long ones
probed. One beyond FAMILY_SHINGLES is not: its classes are first searched in bounded groups, each with a class that they share
a list with; then each short list whose holders are not in one part by now is a group of its own, dealt in blocks, and every
pair of blocks is searched. For components no pairs are emitted, only the links that join parts not joined yet, and a list whose
holders are all in the set's own part already is not read: a group of k near copies costs k short searches and k rows.
jaccard_links() looks at every pair instead and counts them.

Shingles are 64-bit hashes, classes 128-bit ones; a link is confirmed on the hashes of the whole sets.

Defined results: null and empty texts, or texts of blanks, have no shingles and link with nothing; a text with fewer words
than n has the whole sequence as its only shingle. Rows that share a doc_id are one node with the links of all. A row with
a null doc_id takes no part and has a null component. Only id and text are read, so clashing columns cannot matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.components import components
from loomery.llm.rolling import Powers
from loomery.llm.shared import Scratch, lean, partitions_for, quoted

WORDS = 5
SIMILAR = 80  # per cent
SKETCH_BITS = 22
SKETCH_CHUNK = 1 << 16
FAMILY_SHINGLES = 2_000_000
BLOOM_BITS = 1 << 26
PARITY_BITS = 512
PAIRED_LIST = 8
LIST_BLOCK = 4096  # classes of one list compared in a task
FIRST_CANDIDATES, CANDIDATES = 16, 512  # verified at a time
BATCH_BYTES = 512 << 10

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Byte by byte: A-Z to a-z, and which are blanks.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers = Powers()


def utf8(column) -> Iterator[bytes]:
    """The texts of an Arrow array of strings as bytes, null ones empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (x.as_py() or b"" for x in column.cast(kind))


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts in a row, and where each text's begin, with the end behind."""
    data = np.frombuffer(b"".join(b" " + x for x in bodies) + b" ", np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # the first byte is a blank, and so is the last
    starts, ends = edges[::2], edges[1::2]
    size = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum(size)])
    with np.errstate(over="ignore"):
        return _mixed(_powers.hashes(_LOWER[data], starts, ends)), bounds


def shingle_sets(bodies: Iterator[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    held, total = [], 0
    for body in bodies:
        held.append(body)
        total += len(body)
        if total >= BATCH_BYTES:
            yield from _shingles(held, words)
            held, total = [], 0
    if held:
        yield from _shingles(held, words)


def _shingles(bodies: list[bytes], words: int) -> Iterator[np.ndarray]:
    w, bounds = word_hashes(bodies)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for j in range(words):
            h = h * _ODD[0] + w[j : j + len(h)]
        h = _mixed(h)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= words:
                yield np.unique(h[a : b - words + 1])
            elif b > a:
                short = np.uint64(b - a)
                for x in w[a:b]:
                    short = short * _ODD[1] + x
                yield _mixed(np.array([short * _ODD[2]]))
            else:
                yield np.zeros(0, np.uint64)


def needed(n: int, percent: int) -> int:
    """T: the shingles that a document of n must share with any partner."""
    return -(-percent * n // 100)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    import hashlib

    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def frequency_levels(texts: DataFrame, words: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each bucket of shingle hashes a level that grows with the number of documents that have one of them.

    The counts cover all documents. Tasks send their counters compressed, in chunks, which are added up in two steps; what
    comes to the driver has 2 ** bits bytes, whatever the input.
    """
    import zlib

    chunk = min(SKETCH_CHUNK, 1 << bits)

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        counts = np.zeros(1 << bits, np.uint32)  # of one task's documents
        seen = False
        for batch in batches:
            for s in shingle_sets(utf8(batch.column(1)), words):
                seen = True
                np.add.at(counts, (s >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        if seen:
            part = TaskContext.get().partitionId()
            rows = range((1 << bits) // chunk)
            data = [zlib.compress(counts[i * chunk : (i + 1) * chunk].astype("<u4").tobytes(), 1) for i in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.int32()), pa.array([part % 64] * len(rows), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "part", "counts"]
            )

    def total_of(table, kind):
        total = np.zeros(chunk, np.int64)
        for data in table.column("counts"):
            total += np.frombuffer(zlib.decompress(data.as_py()), kind)
        return total

    def summed(key, table):
        import pyarrow as pa

        data = zlib.compress(total_of(table, "<u4").astype("<i8").tobytes(), 1)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([data], pa.binary())})

    def levelled(key, table):
        import pyarrow as pa

        data = (4 * np.log2(1 + total_of(table, "<i8"))).astype(np.uint8).tobytes()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([data], pa.binary())})

    parts = texts.mapInArrow(lean(count), "chunk int, part int, counts binary")
    half = parts.groupBy("chunk", "part").applyInArrow(summed, "chunk int, counts binary")
    whole = half.groupBy("chunk").applyInArrow(levelled, "chunk int, levels binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in whole.collect():
        out[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(row.levels, np.uint8)
    return out


def short_lists(texts: DataFrame, words: int, percent: int, shared) -> DataFrame:
    """doc, n, the set's digest (d1, d2), the hashes of the n - T + 1 rarest shingles, and the parities of all.

    The last two are given once for each set and task: copies have the same. shared is a broadcast of frequency_levels().
    """

    def run(batches):
        import pyarrow as pa

        level_of, told = shared.value, set()
        shift = np.uint64(64 - int(np.log2(len(level_of))))
        for batch in batches:
            sizes, one, two, short, parity = [], [], [], [], []
            for s in shingle_sets(utf8(batch.column(1)), words):
                n = len(s)
                a, b = digest(s) if n else (0, 0)
                sizes.append(n)
                one.append(a)
                two.append(b)
                known = (a, b) in told
                told.add((a, b))
                odd = None if known else parities(s)
                if n and known:
                    s = s[:0]
                elif n:
                    rank = np.lexsort((s, level_of[(s >> shift).astype(np.int64)]))
                    s = s[rank[: n - needed(n, percent) + 1]]
                short.append(s.view(np.int64))
                parity.append(odd)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(short, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))],
                names=["doc", "n", "d1", "d2", "short", "parity"],
            )

    return texts.mapInArrow(lean(run), "doc long, n long, d1 long, d2 long, short array<long>, parity array<long>")


def parities(shingles: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the hashes: is the number of shingles with it odd?

    There are PARITY_BITS remainders, or the power of two up to the number of shingles where that is more.
    """
    bits = max(PARITY_BITS, 1 << max(0, len(shingles).bit_length() - 1))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities as those of fewer remainders, width words a row."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many parities rows differ, taken at the narrower width."""
    width = min(a.shape[1], b.shape[1])
    return np.bitwise_count((folded(a, width) ^ folded(b, width)).view(np.uint64)).sum(1, dtype=np.int64)


def _ragged(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, sizes) of an Arrow array of lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, sizes


def _alike(batches, percent: int):
    """The (a, b) of rows (a, b, na, nb, pa, pb) whose parities allow a link."""
    import pyarrow as pa

    for batch in batches:
        n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        (va, sa, wa), (vb, sb, wb) = _ragged(batch.column(4)), _ragged(batch.column(5))
        apart = np.zeros(len(n), np.int64)
        for x, y in {*zip(wa.tolist(), wb.tolist())}:
            at = np.flatnonzero((wa == x) & (wb == y))
            apart[at] = _apart(va[sa[at, None] + np.arange(x)], vb[sb[at, None] + np.arange(y)])
        yield batch.select([0, 1]).filter(pa.array(apart * (100 + percent) <= n * (100 - percent)))


def paired(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs on lists of at most PAIRED_LIST classes that could link by their sizes and parities.

    Each shingle that is in one set alone flips one parity, so sets that differ in more parities than a link allows in
    shingles cannot link: a chance meeting on one shingle ties no family.
    """
    a, b = lists.toDF("token", "a", "na"), lists.toDF("token", "b", "nb")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = a.join(b, "token").where(near).select("a", "na", "b", "nb").distinct()
    # a 64-bit class id that two classes share has parities of either; a pair is kept if any of them allow it
    first, second = classes.select(F.col("d1").alias("a"), F.col("parity").alias("pa")), classes.select(F.col("d1").alias("b"), F.col("parity").alias("pb"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "pa", "pb")
    return both.mapInArrow(lean(lambda batches: _alike(batches, percent)), "a long, b long").distinct()


def family_edges(lists: DataFrame, classes: DataFrame, percent: int, list_block: int = LIST_BLOCK) -> DataFrame:
    """What ties classes to families: on each list, pairs that join all whose sizes and parities allow a link, directly or not."""
    same = F.sum(F.xxhash64("cls", "n").cast("decimal(38,0)")).alias("who")
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("many"), same)
    few = lists.join(sizes.where(F.col("many") <= PAIRED_LIST), "token").select("token", "cls", "n")
    # lists of the same classes need one search
    large = sizes.where(F.col("many") > PAIRED_LIST).groupBy("many", "who").agg(F.min("token").alias("token"))
    more = lists.join(large, "token").select("token", "cls", "n", "many")
    return paired(few, classes, percent).unionByName(tied(more, classes, percent, list_block)).distinct()


def tied(lists: DataFrame, classes: DataFrame, percent: int, list_block: int) -> DataFrame:
    """Pairs that join the classes of each list (token, cls, n, many), or of each pair of its blocks, by sizes and parities."""
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("many") / F.lit(list_block))).cast("long")
    dealt = lists.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    dealt = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = [F.col("token"), F.least("block", "mate").alias("lo"), F.greatest("block", "mate").alias("hi")]
    known = classes.select(F.col("d1").alias("cls"), "n", "parity")
    rows = dealt.select(*key, "cls", "n").join(known, ["cls", "n"]).select("token", "lo", "hi", "cls", "n", "parity")
    rows = rows.repartition(partitions_for(lists.sparkSession), "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "cls")

    def run(batches):
        import pyarrow as pa

        key, ids, sizes, own = None, [], [], []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            values, starts, widths = _ragged(batch.column(5))
            out = []
            for k, cls, n, at, width in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), starts.tolist(), widths.tolist()):
                if k != key:
                    out += ties(ids, sizes, own, percent)
                    key, ids, sizes, own = k, [], [], []
                ids.append(cls)
                sizes.append(n)
                own.append(values[at : at + width].copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
        if out := ties(ids, sizes, own, percent):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


def ties(ids: list[int], sizes: list[int], parity: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of sets, given by rising size, that join all pairs whose sizes and parities allow a link; less than there are sets."""
    n, width = np.array(sizes, np.int64), np.array([len(x) for x in parity], np.int64)
    # the sets of at least a width, by their parities at that width; as sets are given by size, those of a width are in a row
    at = {w: int(np.searchsorted(width, w)) for w in set(width.tolist())}
    table = {w: np.concatenate([folded(np.stack(parity[at[x] : int(np.searchsorted(width, x, "right"))]), w) for x in sorted(at) if x >= w]) for w in at}
    parts, out = Parts(len(n)), []
    for a in range(1, len(n)):
        least = int(np.searchsorted(n, needed(int(n[a]), percent)))
        for some in (np.arange(max(least, a - 1), a), np.arange(least, a - 1)):
            some = some[parts.roots(some) != parts.root(a)] if len(some) else some
            for w in np.unique(width[some]).tolist():
                few = some[width[some] == w]
                apart = np.bitwise_count((table[w][few - at[w]] ^ table[w][a - at[w]]).view(np.uint64)).sum(1, dtype=np.int64)
                for b in few[apart * (100 + percent) <= (n[a] + n[few]) * (100 - percent)].tolist():
                    if parts.root(a) != parts.root(b):
                        parts.join(a, b)
                        out.append((ids[a], ids[b]))
    return out


class Lists:
    """The inverted lists of some sets, of those shingles that two or more of them hold; sets by size."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        flat, holder = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        by = np.argsort(flat, kind="stable")
        first = np.r_[True, flat[by][1:] != flat[by][:-1]]
        token = np.cumsum(first) - 1
        length = np.bincount(token)
        several = length > 1
        kept = several[token]
        token = (np.cumsum(several) - 1)[token[kept]]
        by = by[kept]
        self.many = int(several.sum())
        self.length = length[several]
        self.at = np.r_[0, np.cumsum(self.length)]
        self.holders = holder[by]  # list by list, each ascending
        # (set, shingle) in order: the target of binary probes, and the shingles of each set
        back = np.argsort(by, kind="stable")
        self.pairs = holder[by[back]].astype(np.int64) * self.many + token[back]
        self.starts = np.searchsorted(self.pairs, np.arange(len(sets) + 1, dtype=np.int64) * self.many)

    def shingles(self, a: int) -> np.ndarray:
        """Those of a set, the shortest lists first."""
        own = self.pairs[self.starts[a] : self.starts[a + 1]] - a * self.many
        return own[np.argsort(self.length[own], kind="stable")]

    def run(self, token: int, low: int, high: int) -> np.ndarray:
        """The holders from low up to high, without it."""
        own = self.holders[self.at[token] : self.at[token + 1]]
        return own[np.searchsorted(own, low) : np.searchsorted(own, high)]

    def probed(self, some: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """How many of the shingles each of some sets holds, by binary search."""
        if not len(tokens):
            return np.zeros(len(some), np.int64)
        probes = (some.astype(np.int64)[:, None] * self.many + tokens[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.pairs, probes), len(self.pairs) - 1)
        return (self.pairs[at] == probes).reshape(len(some), -1).sum(1)


class Parts:
    """Sets joined to parts; each part goes by its least set."""

    def __init__(self, n: int):
        self.above = np.arange(n)

    def roots(self, some: np.ndarray) -> np.ndarray:
        now = self.above[some]
        while True:
            up = self.above[now]
            if (up == now).all():
                self.above[some] = now
                return now
            now = up

    def root(self, a: int) -> int:
        return int(self.roots(np.array([a]))[0])

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        self.above[max(x, y)] = min(x, y)


def linked(ids: list[int], sets: list[np.ndarray], percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Links that join the similar sets of one group, less than there are sets; or every pair of similar sets (DivideSkip)."""
    if len(sets) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
    ids = [ids[i] for i in order]
    lists = Lists([sets[i] for i in order])
    if not lists.many:
        return []
    n, parts = lists.n, Parts(len(sets))
    # of each list: a holder whose part has all holders so far, -1 if there is none yet, -2 if they are in several parts
    of_part = np.full(lists.many, -1)
    links = []

    def verify(a: int, some: np.ndarray, overlap: np.ndarray) -> None:
        for b in some[100 * overlap >= percent * (n[a] + n[some] - overlap)].tolist():
            if every:
                links.append((ids[a], ids[b]))
            elif parts.root(a) != parts.root(b):
                parts.join(a, b)
                links.append((ids[a], ids[b]))

    for a in range(len(sets)):
        tokens = lists.shingles(a)
        need = needed(int(n[a]), percent)
        few = max(0, len(tokens) - (need - 1))  # the short lists; L = need - 1 long ones are set aside
        short, long = tokens[:few], tokens[few:]
        least = int(np.searchsorted(n, need))  # smaller sets cannot be partners
        if every:
            waiting = short
        else:
            pivots = np.unique(of_part[short])
            for b in pivots[pivots >= least].tolist():
                if parts.root(a) != parts.root(b):
                    verify(a, np.array([b]), lists.probed(np.array([b]), tokens))
            state = of_part[short]
            waiting = short[(state == -2) | ((state >= 0) & (parts.roots(np.maximum(state, 0)) != parts.root(a)))]
        runs = [run.tolist() for t in waiting if len(run := lists.run(t, least, a))]
        merged = [(b, sum(1 for _ in same)) for b, same in groupby(heapq.merge(*runs))] if len(runs) > 1 else [(b, 1) for run in runs for b in run]
        step, i = (CANDIDATES if every else FIRST_CANDIDATES), 0
        while i < len(merged):
            some, hits = np.array(merged[i : i + step]).T
            i, step = i + step, CANDIDATES
            if not every:
                apart = parts.roots(some) != parts.root(a)
                some, hits = some[apart], hits[apart]
            if len(some):
                # none of them is on a list that was left out: such a list is of a's own part or empty
                verify(a, some, hits + lists.probed(some, long))
        if not every:
            mine = parts.root(a)
            for t in waiting:  # lists that have come to be of one part
                if of_part[t] == -2 and (parts.roots(lists.run(t, 0, a)) == mine).all():
                    of_part[t] = a
            state = of_part[tokens]
            of_part[tokens] = np.where((state == -1) | (state >= 0) & (parts.roots(np.maximum(state, 0)) == mine), a, -2)
    return links


def _grouped_links(rows: DataFrame, words: int, percent: int, every: bool) -> DataFrame:
    """Links within each group of rows (group columns g1, g2, g3; doc; packed text)."""
    spark = rows.sparkSession
    rows = rows.repartition(partitions_for(spark), "g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "doc")

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        key, ids, sets, out = None, [], [], []
        for batch in batches:
            g = [batch.column(i).to_pylist() for i in range(3)]
            found = shingle_sets((unpack(x.as_py()) for x in batch.column(4)), words)
            for row_key, doc, own in zip(zip(*g), batch.column(3).to_pylist(), found):
                if row_key != key:
                    out += linked(ids, sets, percent, every)
                    key, ids, sets = row_key, [], []
                ids.append(doc)
                sets.append(own)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out = []
        out += linked(ids, sets, percent, every)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return rows.select("g1", "g2", "g3", "doc", "packed").mapInArrow(lean(run), "a long, b long")


def _wanted_texts(texts: DataFrame, wanted: DataFrame):
    """(doc, text compressed) of the wanted docs and few others, and a broadcast to destroy once they are read.

    A bit map of fixed size keeps most from the shuffle.
    """
    spot = F.pmod(F.xxhash64("doc"), F.lit(BLOOM_BITS))
    bits = (
        wanted.select(spot.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        .collect()  # BLOOM_BITS / 8 bytes at most
    )
    span = 8 * len(bits[0].bits) if bits else 1
    marks = texts.sparkSession.sparkContext.broadcast({r.bucket: bytes(r.bits) for r in bits})
    placed = texts.select("doc", "body", F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit"))

    def run(batches):
        import pyarrow as pa
        import zstandard

        known, pack = marks.value, zstandard.ZstdCompressor(level=5).compress
        for batch in batches:
            hit = []
            for bucket, bit in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = known.get(bucket) if bit is not None else None
                hit.append(own is not None and bool(own[(bit % span) >> 3] >> (bit & 7) & 1))
            some = batch.filter(pa.array(hit, pa.bool_()))
            docs = some.column(0)
            if len(docs):
                data = [pack(x) for x in utf8(some.column(1))]
                yield pa.RecordBatch.from_arrays([docs, pa.array(data, pa.binary())], names=["doc", "packed"])

    return placed.mapInArrow(lean(run), "doc long, packed binary"), marks


def _join(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, family_shingles: int, every: bool, steps: Scratch):
    """(rows, classes, links): what is known of each row, the classes of equal sets, and links between classes' least docs.

    Without every, the links join what is similar, directly or not; with it they are all pairs of classes that are.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(quoted(text_col)).alias("body"))
    levels = spark.sparkContext.broadcast(frequency_levels(texts, words))
    rows = steps.written(short_lists(texts, words, percent, levels), "short-lists")
    levels.destroy()
    live = rows.where("doc is not null and n > 0")

    # classes of equal sets, and the short lists that two or more of them share
    reps = steps.written(live.groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.max("n").alias("n"), F.min("parity").alias("parity")), "classes")
    # (a window, so that the entries are shuffled once; an aggregate and a join would shuffle them twice)
    entries = live.select(F.explode("short").alias("token"), F.col("d1").alias("cls"), "n")
    holders = W.partitionBy("token")
    shared = entries.withColumn("lo", F.min("cls").over(holders)).withColumn("hi", F.max("cls").over(holders)).where("lo <> hi")
    lists = steps.written(shared.select("token", "cls", "n").distinct(), "lists")

    families = components(family_edges(lists, reps, percent)).select(F.col("node").alias("cls"), F.col("component").alias("family"))
    members = steps.written(reps.join(families, reps.d1 == families.cls).select("rep", "d1", "n", "family"), "members")
    weights = members.groupBy("family").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = members.join(weights, "family")
    bodies, marks = _wanted_texts(texts, members.select(F.col("rep").alias("doc")))
    zero = F.lit(0).cast("long")

    small = members.where(F.col("weight") <= family_shingles).select(F.col("family").alias("g1"), zero.alias("g2"), zero.alias("g3"), F.col("rep").alias("doc"))
    large = members.where(F.col("weight") > family_shingles).select(F.col("rep").alias("doc"), F.col("d1").alias("cls"), "n")
    if every or large.isEmpty():
        dealt = small.unionByName(_blocks(large, lists, family_shingles))
        links = steps.written(_grouped_links(dealt.join(bodies, "doc"), words, percent, every), "links")
    else:
        first = small.unionByName(_stars(large, lists, family_shingles))
        found = steps.written(_grouped_links(first.join(bodies, "doc"), words, percent, False), "first-links")
        rest = _blocks(large, _unsettled(large, lists, found), family_shingles)
        links = steps.written(found.unionByName(_grouped_links(rest.join(bodies, "doc"), words, percent, False)), "links")
    marks.destroy()
    return rows, reps, links


def _stars(large: DataFrame, lists: DataFrame, family_shingles: int) -> DataFrame:
    """The classes of large families in bounded groups, each once, with the least class they share a list with."""
    own = lists.select("token", "cls").join(large, "cls")
    least = own.groupBy("token").agg(F.min("cls").alias("centre"))
    star = own.join(least, "token").groupBy("cls").agg(F.min("centre").alias("centre"), F.min("doc").alias("doc"), F.min("n").alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.sum("n") / F.lit(family_shingles))).cast("long").alias("blocks")
    dealt = star.groupBy("centre").agg(blocks)
    zero = F.lit(0).cast("long")
    # each class in its block, and the centre in every block of its own
    rays = star.join(dealt, "centre").select("centre", F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("block"), "doc")
    spots = dealt.select("centre", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))
    centres = spots.join(large.select(F.col("cls").alias("centre"), "doc"), "centre")
    # a group of its own key: families go by g2 = 0
    return rays.unionByName(centres.select("centre", "block", "doc")).distinct().select(F.col("centre").alias("g1"), F.lit(1).cast("long").alias("g2"), F.col("block").alias("g3"), "doc")


def _unsettled(large: DataFrame, lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists of large families whose holders are in several parts by the links found."""
    parts = components(found).select(F.col("node").alias("doc"), F.col("component"))
    own = lists.select("token", "cls").join(large, "cls").join(parts, "doc", "left").withColumn("part", F.coalesce("component", "doc"))
    several = own.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
    return lists.join(several, "token", "left_semi")


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILAR, family_shingles: int = FAMILY_SHINGLES
) -> DataFrame:
    """(doc, n_shingles, component_id) for each row: component_id is the least doc that links lead to, itself included.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct shingles of that many words.
    """
    steps = Scratch(docs.sparkSession)
    rows, reps, links = _join(docs, id_col, text_col, words, percent, family_shingles, False, steps)
    live = rows.where("doc is not null and n > 0")
    several = live.groupBy("doc").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("doc")
    again = live.join(several, "doc", "left_semi").join(reps.select("d1", "d2", "rep"), ["d1", "d2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    groups = components(links.unionByName(again))

    named = rows.select("doc", "n", "d1", "d2").join(reps.select("d1", "d2", "rep"), ["d1", "d2"], "left")
    out = named.join(groups, F.coalesce("rep", "doc") == F.col("node"), "left")
    least = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    return steps.last(out.select("doc", F.col("n").alias("n_shingles"), least.alias("component_id")), "jaccard-classes")


def jaccard_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILAR, family_shingles: int = FAMILY_SHINGLES
) -> tuple[DataFrame, DataFrame]:
    """Every link, without expanding copies: (doc, class_id, n_shingles, n_links) for each row, and (a, b) for each pair of classes.

    A class is the rows of one set of shingles and goes by its least doc; it is null for rows without shingles or doc. a < b are
    classes that link. n_links is the number of other rows that a row links with, those of its own class included.
    """
    steps = Scratch(docs.sparkSession)
    rows, reps, links = _join(docs, id_col, text_col, words, percent, family_shingles, True, steps)
    pairs = steps.last(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "jaccard-pairs", clear=False)
    live = rows.where("doc is not null and n > 0")
    sizes = live.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("size")).join(reps.select("d1", "d2", "rep"), ["d1", "d2"])
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(sizes.select(F.col("rep").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("beside"))
    counted = sizes.join(beside, F.col("rep") == F.col("a"), "left").select("d1", "d2", "rep", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))
    out = rows.select("doc", "n", "d1", "d2").join(counted, ["d1", "d2"], "left")
    own = F.col("doc").isNotNull() & (F.col("n") > 0)
    out = out.select("doc", F.when(own, F.col("rep")).alias("class_id"), F.col("n").alias("n_shingles"), F.when(own, F.col("links")).otherwise(0).alias("n_links"))
    return steps.last(out, "jaccard-links"), pairs


def _blocks(large: DataFrame, lists: DataFrame, family_shingles: int) -> DataFrame:
    """The short lists of large families as groups: one for each pair of a list's blocks."""
    own = lists.select("token", "cls").join(large, "cls")
    heavy = own.groupBy("token").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who"))
    # lists of the same documents need one search
    heavy = heavy.where("size > 1").groupBy("size", "weight", "who").agg(F.min("token").alias("token"))
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("weight") / F.lit(family_shingles))).cast("long")
    dealt = own.join(heavy.withColumn("blocks", blocks).select("token", "blocks"), "token").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    mate = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("mate")
    return dealt.select("token", "doc", "block", mate).select(
        F.col("token").alias("g1"), F.least("block", "mate").alias("g2"), F.greatest("block", "mate").alias("g3"), "doc"
    )


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_classes(docs, words=4, percent=85).withColumnRenamed("doc", "doc_id")


OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents
),
s as (
  select distinct doc_id, hash(array_to_string(w[i : i + least(4, len(w)) - 1], ' ')) as g
  from (select doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) as i from w where len(w) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
overlap_of as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (
  select x, y from overlap_of join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)
),
edge as (select x, y from link union select y, x from link),
reach(x, y) as (select x, y from edge union select r.x, e.y from reach r join edge e on r.y = e.x)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(min(reach.y), w.doc_id)) as component_id
from w left join n on w.doc_id = n.doc_id left join reach on reach.x = w.doc_id group by w.doc_id, n.n
"""
