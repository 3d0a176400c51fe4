"""Approximate nearest neighbours by multiprobe p-stable hashing.

A vector, scaled to length one, is projected on a few Gaussian (2-stable) directions, shifted and cut into slots; the slots
of a table's projections are its bucket. A query visits its own bucket and perturbed ones, a slot up or down in some of the
projections, in the order of their estimated success: the sum of squared distances to the borders crossed. The candidates of
all tables are ranked by their exact cosine in double precision on the original vectors.

The number of probes is the least that reaches TARGET_RECALL on a bounded sample of queries, whose true neighbours are
found by comparing the sample with every row. Every row is indexed. Bucket by bucket, queries and rows meet in a task as
matrices; a bucket with more rows or queries than fit is dealt in blocks, each block of rows meeting each of queries.
Queries that find fewer than k take an exact search, and so do all if the sample's recall stays below LEAST_RECALL: they are
written in blocks to the shared folder, and each task holds its rows against one block after the other, in one pass.

Defined results: vectors that are null or zero or hold null or non-finite numbers take no part; a query meets only vectors
of its own length; rows that share an id are one candidate, at its nearest, and never a candidate of that id's own query;
of candidates whose cosines are equal the smaller id comes first, where a cosine is the double next to the true one, so that
parallel vectors are ties; fewer than k candidates give fewer rows; an empty table gives no row.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.shared import file_system, lean, partitions_for, quoted, scratch, written

TABLES = 8
PROJECTIONS = 8
WIDTH = 2.0
TARGET_RECALL = 0.96
SAMPLE_QUERIES = 256
LEAST_RECALL = 0.9  # below it, every query takes the exact way
MAX_PROBES = 729
NEVER = 1 << 40
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
MARGIN = 2e-12  # what a matrix product may be off by
HELD_BYTES = 64 << 20  # of rows that a task of the exact way holds at a time
SEED = 5


def projections(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table])
    return rng.standard_normal((dim, PROJECTIONS)), rng.random(PROJECTIONS) * WIDTH


def bucket_keys(slots: np.ndarray) -> np.ndarray:
    """One integer for each row of slots; slots of unit vectors are far within +-64."""
    return (slots.astype(np.int64) + 64) @ (128 ** np.arange(PROJECTIONS, dtype=np.int64))


def probe_order(fraction: np.ndarray, most: int) -> list[tuple]:
    """Perturbations (which projections go down or up), the likeliest first, by heap over shifted and expanded sets."""
    moves = sorted([(f * f, i, -1) for i, f in enumerate(fraction)] + [((1 - f) ** 2, i, 1) for i, f in enumerate(fraction)])
    out: list[tuple] = [()]
    heap = [(moves[0][0], (0,))]
    while heap and len(out) < most:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({moves[i][1] for i in chosen}) == len(chosen):
            out.append(tuple((moves[i][1], moves[i][2]) for i in chosen))
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def probed_keys(vectors: np.ndarray, table: int, probes: int) -> list[np.ndarray]:
    """For each query vector the keys of the buckets to visit, in order."""
    directions, shift = projections(vectors.shape[1], table)
    place = (unit(vectors) @ directions + shift) / WIDTH
    slots = np.floor(place)
    out = []
    for own, at in zip(slots, place - slots):
        visited = np.repeat(own[None, :], probes, 0)
        sets = probe_order(at, probes)
        for row, moves in zip(visited, sets):
            for i, step in moves:
                row[i] += step
        out.append(bucket_keys(visited[: len(sets)]))
    return out


def own_keys(vectors: np.ndarray, table: int) -> np.ndarray:
    directions, shift = projections(vectors.shape[1], table)
    return bucket_keys(np.floor((unit(vectors) @ directions + shift) / WIDTH))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(quoted(vector_col))
    if df.schema[vector_col].dataType.simpleString() != "array<float>":  # these are shuffled as they are, half the size
        v = v.cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(quoted(id_col)).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The cosine of one vector with each of several: in extended precision, then as the nearest double."""
    q, c = q.astype(np.longdouble), c.astype(np.longdouble)
    return ((q * c).sum(1) / np.sqrt((q * q).sum() * (c * c).sum(1))).astype(np.float64)


def close_ones(q_ids, q, c_ids, c, k: int) -> np.ndarray:
    """Which candidates of each query may be among its k nearest distinct ids: all that rounding cannot tell from the k-th."""
    near = (q @ c.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)[None, :]
    near[(q_ids[:, None] == c_ids[None, :]) | ~np.isfinite(near)] = -np.inf
    order = np.argsort(c_ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(c_ids[order]) != 0])
    of_ids = near if len(starts) == len(c_ids) else np.maximum.reduceat(near[:, order], starts, axis=1)
    if of_ids.shape[1] <= k:
        return np.isfinite(near)
    least = np.partition(of_ids, of_ids.shape[1] - k, axis=1)[:, -k]
    return (near >= least[:, None] - MARGIN - 8 * q.shape[1] * np.finfo(float).eps) & np.isfinite(near)


def without_equals(c_ids, c, k: int):
    """The rows without those that more than k smaller ids equal: no query, whose own id is one of them at most, needs these."""
    whole = np.ascontiguousarray(c + 0.0).view(np.dtype((np.void, c.shape[1] * c.itemsize))).ravel()
    group = np.unique(whole, return_inverse=True)[1].ravel()
    order = np.lexsort((c_ids, group))
    group, ids = group[order], c_ids[order]
    new = np.r_[True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])]
    order, group = order[new], group[new]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    kept = order[place <= k]
    return c_ids[kept], c[kept]


def best_of(q_ids, q, c_ids, c, k: int):
    """(query, candidate, exact cosine) of the k nearest distinct candidates of each query, never its own id; of ties the smaller ids."""
    close = close_ones(q_ids, q, c_ids, c, k)
    if close.sum() > 4 * k * len(q_ids):
        c_ids, c = without_equals(c_ids, c, k)
        close = close_ones(q_ids, q, c_ids, c, k)
    for i, kept in enumerate(close):
        some = np.flatnonzero(kept)
        if len(some):
            exact = cosines(q[i], c[some])
            order = np.lexsort((c_ids[some], -exact))
            some, exact = some[order], exact[order]
            done: set = set()
            for vec, score in zip(c_ids[some].tolist(), exact.tolist()):
                if vec not in done:
                    done.add(vec)
                    yield int(q_ids[i]), vec, score
                    if len(done) == k:
                        break


def best_first(found: dict) -> list[tuple[int, float]]:
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


class Nearest:
    """The k best candidates of each query so far."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, query: int, vec: int, score: float):
        own = self.of.setdefault(query, {})
        if score > own.get(vec, -2):
            own[vec] = score
            if len(own) > 4 * self.k:
                self.of[query] = dict(best_first(own)[: self.k])

    def batch(self):
        import pyarrow as pa

        rows = [(q, v, s) for q, own in self.of.items() for v, s in best_first(own)[: self.k]]
        self.of = {}
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def vectors_of(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64, copy=False)


def exact_search(queries: list[tuple[int, list[float]]], rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of a bounded block of queries, among all rows, for each task; to be merged."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        asked: dict[int, list] = {}
        for i, v in shared.value:
            asked.setdefault(len(v), []).append((i, v))
        held = {d: (np.array([i for i, _ in x]), np.array([v for _, v in x])) for d, x in asked.items()}
        found = Nearest(k)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sizes = np.array([len(v) for v in batch.column(1)])
            for dim in set(sizes.tolist()) & held.keys():
                some = np.flatnonzero(sizes == dim)
                for at in range(0, len(some), BLOCK_ROWS):
                    part = some[at : at + BLOCK_ROWS]
                    for hit in best_of(*held[dim], ids[part], vectors_of(batch.column(1).take(part), dim), k):
                        found.add(*hit)
        yield found.batch()

    return rows.mapInArrow(lean(run), FOUND)


def exact_of(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """exact_search() of any number of queries: written in blocks, and read block by block by each task that holds rows."""
    path = scratch(rows.sparkSession, "queries")
    queries.select("id", F.col("v").cast("array<double>").alias("v")).write.option("parquet.block.size", 8 << 20).parquet(path)

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs as afs

        fs, folder = file_system(path)
        files = [f.path for f in fs.get_file_info(afs.FileSelector(folder)) if f.path.endswith(".parquet")]

        def asked():
            for name in files:
                with fs.open_input_file(name) as f:
                    for block in pq.ParquetFile(f).iter_batches(BLOCK_QUERIES, columns=["id", "v"]):
                        yield block.column(0).to_numpy(), block.column(1)

        def lengths(lists):
            return np.diff(lists.offsets.to_numpy())

        def met(parts):
            """The rows held, by length, against every query."""
            by_dim: dict[int, list] = {}
            for ids, lists in parts:
                sizes = lengths(lists)
                for dim in np.unique(sizes).tolist():
                    some = np.flatnonzero(sizes == dim)
                    by_dim.setdefault(dim, []).append((ids[some], lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
            held = {d: (np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])) for d, x in by_dim.items()}
            for ids, lists in asked():
                found, sizes = Nearest(k), lengths(lists)
                for dim in set(np.unique(sizes).tolist()) & held.keys():
                    some = np.flatnonzero(sizes == dim)
                    q, (c_ids, c) = vectors_of(lists.take(pa.array(some)), dim), held[dim]
                    for at in range(0, len(c), BLOCK_ROWS):
                        for hit in best_of(ids[some], q, c_ids[at : at + BLOCK_ROWS], c[at : at + BLOCK_ROWS].astype(np.float64), k):
                            found.add(*hit)
                yield found.batch()

        parts, size = [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1)))
            size += batch.nbytes
            if size > HELD_BYTES:
                yield from met(parts)
                parts, size = [], 0
        if parts:
            yield from met(parts)

    return rows.mapInArrow(lean(run), FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def probes_needed(rows: DataFrame, is_query, k: int) -> tuple[int, float]:
    """The least number of probes that finds TARGET_RECALL of the true neighbours of SAMPLE_QUERIES queries, and what it finds.

    No more than MAX_PROBES; the share then says how far these come.
    """
    sample = [(r.id, r.v) for r in rows.where(is_query).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).collect()]
    if not sample:
        return 1, 1.0
    truth = ranked(exact_search(sample, rows, k), k).select("query_id", F.col("vec_id").alias("id"))
    pairs = truth.join(rows, "id").dropDuplicates(["query_id", "id"]).collect()  # k vectors for each sampled query
    if not pairs:
        return 1, 1.0
    asked = dict(sample)
    pairs = [r for r in pairs if len(r.v) == len(asked[r.query_id])]
    at = np.full(len(pairs), NEVER, int)
    for table in range(TABLES):
        for dim in {len(v) for v in asked.values()}:
            mine = [i for i, v in sample if len(v) == dim]
            keys = dict(zip(mine, probed_keys(np.array([asked[i] for i in mine]), table, MAX_PROBES)))
            some = [j for j, r in enumerate(pairs) if len(r.v) == dim]
            if some:
                for j, key in zip(some, own_keys(np.array([pairs[j].v for j in some]), table)):
                    hit = np.flatnonzero(keys[pairs[j].query_id] == key)
                    if len(hit):
                        at[j] = min(at[j], hit[0])
    probes = int(min(MAX_PROBES, np.sort(at)[min(len(at) - 1, int(np.ceil(TARGET_RECALL * len(at))))] + 1))
    return probes, float((at < probes).mean())


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", told: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine of each row for which is_query, a condition on id.

    told, if given, gets the probes and the recall of the sample that they were chosen by.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    probes, recall = probes_needed(rows, is_query, k)
    if told is not None:
        told.update(probes=probes, recall=recall)
    if recall < LEAST_RECALL:
        return ranked(exact_of(rows.where(is_query), rows, k), k)

    def keyed(as_query: bool):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                sizes = np.array([len(v) for v in batch.column(1)])
                for dim in sorted(set(sizes.tolist())):
                    some = pa.array(np.flatnonzero(sizes == dim))
                    ids, vectors = batch.column(0).take(some), batch.column(1).take(some)
                    matrix = vectors_of(vectors, dim)
                    for table in range(TABLES):
                        if as_query:
                            for i, keys in enumerate(probed_keys(matrix, table, probes)):
                                n = len(keys)
                                take = pa.array(np.full(n, i))
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(n, dim)), pa.array(np.full(n, table)), pa.array(keys), ids.take(take), vectors.take(take)], names=names
                                )
                        else:
                            n = len(ids)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, dim)), pa.array(np.full(n, table)), pa.array(own_keys(matrix, table)), ids, vectors], names=names
                            )

        return run

    names = ["dim", "tab", "bucket", "id", "v"]
    schema = f"dim long, tab long, bucket long, id long, v {rows.schema['v'].dataType.simpleString()}"
    key = ["dim", "tab", "bucket"]
    index = rows.mapInArrow(lean(keyed(False)), schema)
    asked = rows.where(is_query).mapInArrow(lean(keyed(True)), schema)

    # buckets with more than a block of rows or queries are dealt in blocks
    held = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
    put = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK_QUERIES)
    sizes = held.join(put, key, "full").select(
        *key,
        F.coalesce(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).cast("long").alias("of_rows"),
        F.coalesce(F.ceil(F.col("m") / BLOCK_QUERIES), F.lit(1)).cast("long").alias("of_queries"),
    )
    sizes = written(sizes, "buckets")

    def dealt(frame: DataFrame, kind: int) -> DataFrame:
        frame = frame.join(sizes, key, "left")
        mine, other = ("of_rows", "of_queries") if kind else ("of_queries", "of_rows")
        own = F.pmod(F.xxhash64("id"), F.coalesce(F.col(mine), F.lit(1))).cast("long")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1)) - 1))
        frame = frame.withColumn("own", own).withColumn("each", each)
        i, j = ("own", "each") if kind else ("each", "own")
        return frame.select(*key, F.col(i).alias("i"), F.col(j).alias("j"), F.lit(kind).alias("kind"), "id", "v")

    place = [*key, "i", "j"]
    met = dealt(asked, 0).unionByName(dealt(index, 1)).repartition(partitions_for(spark), *place).sortWithinPartitions(*place, "kind")

    def search(batches):
        found, now, queries = Nearest(k), None, None
        waiting_ids, waiting, c_ids, c = [], [], [], []

        def meet():
            nonlocal c_ids, c, queries
            if c_ids and (waiting or queries):
                if queries is None:
                    queries = np.concatenate(waiting_ids), np.concatenate(waiting)
                for hit in best_of(*queries, np.concatenate(c_ids), np.concatenate(c), k):
                    found.add(*hit)
            c_ids, c = [], []

        for batch in batches:
            places = np.stack([batch.column(i).to_numpy() for i in range(5)], 1)
            kinds = batch.column(5).to_numpy()
            ids = batch.column(6).to_numpy()
            new = np.r_[True, (places[1:] != places[:-1]).any(1) | (kinds[1:] != kinds[:-1])]
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], len(kinds)]):
                if now is None or (places[a] != now).any():
                    meet()
                    now, queries, waiting_ids, waiting = places[a], None, [], []
                vectors = vectors_of(batch.column(7).slice(a, b - a), int(places[a][0]))
                if kinds[a]:
                    if waiting:
                        c_ids.append(ids[a:b])
                        c.append(vectors)
                        if sum(map(len, c_ids)) >= BLOCK_ROWS:
                            meet()
                else:
                    waiting_ids.append(ids[a:b])
                    waiting.append(vectors)
            if len(found.of) > 100_000:
                yield found.batch()
        meet()
        yield found.batch()

    hits = written(ranked(met.mapInArrow(lean(search), FOUND), k), "neighbours")

    # those that found fewer than k
    few = written(rows.where(is_query).join(hits.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti"), "few")
    if few.isEmpty():
        return hits
    return ranked(hits.select("query_id", "vec_id", "score").unionByName(exact_of(few, rows, k)), k)


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("id") % 50 == 0)
