"""Curation: first-wins deduplication, leak-safe splits, quotas and precedence.

Order is always an explicit column. Keys are hashed to 20 bytes before they are shuffled; callers that need no text behind a
step leave it out in front of it, so that long texts are not shuffled at all.

Defined results, for all of them: a null key is a key of its own; empty tables give empty ones; extra columns stay, helper
columns have free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions import text as X
from loomery.functions.columns import free_name, quoted
from loomery.sources.scratch import fixed

EDGE_ROWS = 100_000  # ranked in one task at most
FEW_GROUPS, SALTS = 100_000, 16  # groups whose bounds are broadcast at most; parts of a large group beyond that
TIER_DIGITS = 10


def first_wins(df: DataFrame, key: Column, *order: str, drop_blank: bool = False) -> DataFrame:
    """One row a key: the earliest, by a pre-aggregated minimum, so a key that many rows share is no burden.

    Of rows whose order columns are equal that of the least hash stays; of identical rows, one. drop_blank leaves out null
    and empty keys, which is what a corpus build wants; else they are keys like others.
    """
    digest, row = free_name("key_digest", df), free_name("row", df)
    columns = [F.col(quoted(c)) for c in df.columns]
    marked = df.where(key.isNotNull() & (key != "")) if drop_blank else df
    marked = marked.select(F.sha1(key).alias(digest), *columns)
    rank = F.struct(*[F.col(quoted(c)) for c in order], F.xxhash64(*columns))
    return marked.groupBy(digest).agg(F.min_by(F.struct(*columns), rank).alias(row)).select(f"{row}.*")


def any_of_key(df: DataFrame, key: Column, flag: Column, out: str) -> DataFrame:
    """Every row with the OR of a flag over its key: is its key among those of a flagged row? Null flags are false."""
    digest, hit, other = free_name("key_digest", df), free_name("hit", df), free_name("flagged_digest", df)
    marked = df.withColumn(digest, F.sha1(key))
    flagged = marked.where(flag).select(F.col(digest).alias(other)).distinct().withColumn(hit, F.lit(True))
    joined = marked.join(flagged, F.col(digest).eqNullSafe(F.col(other)), "left")
    return joined.select(*[F.col(quoted(c)) for c in df.columns if c != out], F.coalesce(hit, F.lit(False)).alias(out))


def split_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """df with part_key and part: train, locked or dev. Disjoint in the key by construction."""
    held, locked = X.is_held_out(F.col(text)), X.is_locked(F.col(text))
    part = F.when(~held, "train").when(locked, "locked").otherwise("dev")
    return df.withColumn("part_key", X.partition_key(F.col(text))).withColumn("part", part)


def precedence_union(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """All rows, but of equal keys only that of the earliest frame."""
    out = None
    for i, df in enumerate(frames):
        part = df.withColumn("prio", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return first_wins(out, X.dedup_key(F.col(key)), "prio", order)


def without(df: DataFrame, drop: DataFrame, key: Column, drop_key: Column) -> DataFrame:
    """df but for the rows whose key is on the drop list; null keys are on no list."""
    mine, listed = free_name("key", df), free_name("dropped_key", df)
    return df.withColumn(mine, key).join(drop.select(drop_key.alias(listed)).distinct(), F.col(mine) == F.col(listed), "left_anti").drop(mine)


def drop_summary(df: DataFrame, drop: DataFrame, key: Column, drop_key: Column, by: str) -> DataFrame:
    """(by, n, kept, dropped): how many rows of each group without() keeps and drops, counted at once."""
    mine, listed, hit = free_name("key", df), free_name("dropped_key", df), free_name("hit", df)
    keys = drop.select(drop_key.alias(listed)).where(F.col(listed).isNotNull()).distinct().withColumn(hit, F.lit(True))
    marked = df.select(F.col(quoted(by)).alias(by), key.alias(mine)).join(keys, F.col(mine) == F.col(listed), "left")
    gone = F.col(hit).isNotNull()
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~gone).alias("kept"), F.count_if(gone).alias("dropped"))


class QuarantineError(ValueError):
    """Some rows were bad; the good ones and the bad ones are written all the same."""


def quarantine(df: DataFrame, ok: Column, message: Column, id_col: str, shown: int = 5) -> tuple[DataFrame, DataFrame]:
    """(good rows, report): the report is one row, how many are bad and the messages of the first few by id. Null is not ok.

    The report is made here, in one pass: the bad rows are counted on their way to the top few.
    """
    counted = Observation()
    bad = df.where(~F.coalesce(ok, F.lit(False))).select(F.col(quoted(id_col)).alias("at"), message.alias("said"))
    first = bad.observe(counted, F.count(F.lit(1)).alias("bad")).orderBy("at", "said").limit(shown).collect()
    report = df.sparkSession.createDataFrame([(counted.get["bad"], [r.said for r in first])], "bad long, messages array<string>")
    return df.where(ok), report


def write_checked(df: DataFrame, ok: Column, message: Column, id_col: str, path: str, shown: int = 5, fmt: str = "parquet") -> int:
    """Writes df below path, the good rows in quarantined=false and the bad ones, with said, in quarantined=true; the number of good ones.

    One pass: rows are judged and counted while they are written. If any is bad, QuarantineError is raised at the end, with
    the number and the messages of the first few by id, which are read from what was written. Null is not ok.
    """
    flag, said = "quarantined", free_name("said", df)
    counted = Observation()
    bad = ~F.coalesce(ok, F.lit(False))
    judged = df.select(*[F.col(quoted(c)) for c in df.columns if c != flag], F.when(bad, message).alias(said), bad.alias(flag))
    judged = judged.observe(counted, F.count(F.lit(1)).alias("all"), F.count_if(flag).alias("bad"))
    judged.write.mode("overwrite").partitionBy(flag).format(fmt).save(path)
    n = counted.get
    if n["bad"]:
        rows = df.sparkSession.read.schema(judged.schema).format(fmt).load(path).where(F.col(flag).cast("boolean"))
        first = [str(r[0]) for r in rows.orderBy(F.col(quoted(id_col)), said).limit(shown).select(said).collect()]
        raise QuarantineError(f"{n['bad']} of {n['all']} rows are bad: " + "; ".join(first))
    return n["all"]


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text can stand as one line of a line protocol: not null or blank, without line ends and tabs."""
    t = F.col(quoted(text))
    return df.where(t.isNotNull() & (F.trim(t) != "") & ~t.rlike("[\\n\\r\\t]"))


def with_reasons(df: DataFrame, drop: DataFrame, key: Column, drop_key: Column, reason: str) -> DataFrame:
    """The rows that without() drops, each with the least reason the list gives for it."""
    mine, listed, why = free_name("key", df), free_name("dropped_key", df), free_name("why", df)
    reasons = drop.select(drop_key.alias(listed), F.col(quoted(reason)).alias(why)).groupBy(listed).agg(F.min(why).alias(why))
    joined = df.withColumn(mine, key).join(reasons, F.col(mine) == F.col(listed))
    return joined.select(*[F.col(quoted(c)) for c in df.columns if c != reason], F.col(why).alias(reason))


def cut(df: DataFrame, by: str, limit: Column, key: Column, id_col: str, tier: Column | None = None, edge_rows: int = EDGE_ROWS, few: int = FEW_GROUPS) -> DataFrame:
    """The first rows of each group, as many as limit says: by tier, the key's hash, the id's hash, and a hash of the row.

    No group is sorted. Counts by the first digits of the hash say, group by group, where its bound falls; beside the bound
    three digits more are counted, then all of them, until the rows there are few enough to be ranked. Beyond edge_rows only
    rows of one hash are ranked together. limit is a number or an expression of by; groups whose limit is null or below 1 give nothing.
    """
    g, h, most, n, upto, bound, want = (free_name(c, df) for c in ("cut_group", "cut_hash", "cut_most", "cut_n", "cut_upto", "cut_bound", "cut_want"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    head = F.lpad(tier.cast("string"), TIER_DIGITS, "0") if tier is not None else F.lit("")
    hashed = df.select(
        "*", F.coalesce(F.concat(F.lit("="), F.col(quoted(by)).cast("string")), F.lit("")).alias(g),
        F.concat(head, F.sha1(text(key)), F.sha1(text(F.col(quoted(id_col))))).alias(h), limit.cast("long").alias(most),
    ).where(F.col(most) > 0)
    ahead = TIER_DIGITS if tier is not None else 0
    sizes = [ahead or 3, ahead + (3 if ahead else 6), *([ahead + 6] if ahead else []), ahead + 80]
    rows, bounds = hashed.select(g, h, F.lit("").alias(bound), F.col(most).alias(want)), None
    for size in sizes:
        counts = rows.groupBy(g, F.substring(h, 1, size).alias(bound)).agg(F.count(F.lit(1)).alias(n), F.max(want).alias(want))
        summed = counts.withColumn(upto, F.sum(n).over(W.partitionBy(g).orderBy(bound)))  # a row for each next digits
        last = summed.where(F.col(upto) > F.col(want)).groupBy(g).agg(F.min_by(F.struct(bound, (F.col(want) - F.col(upto) + F.col(n)).alias(want), n), bound).alias(upto)).select(g, f"{upto}.*")
        done = last if bounds is None else bounds.join(last.select(g), g, "left_anti").unionByName(last)
        bounds = fixed(done)
        wide = (F.col(want) > 0) & (F.col(n) > edge_rows)
        if size == sizes[-1] or not bounds.where(wide).limit(1).count():
            break
        edges = bounds.where(wide).select(g, bound, want)
        rows = looked_up(hashed.select(g, h, F.substring(h, 1, size).alias(bound)), edges, [g, bound], few)
    kept = [F.col(quoted(c)) for c in df.columns]
    looked = looked_up(hashed, bounds.drop(n), [g], few, "left")
    inside = looked.where(F.col(bound).isNull() | (F.col(h) < F.col(bound))).select(*kept)
    edge = looked.where(F.startswith(F.col(h), F.col(bound)) & (F.col(want) > 0))
    rank = F.row_number().over(W.partitionBy(g).orderBy(h, F.xxhash64(*kept)))
    return inside.unionByName(edge.withColumn(n, rank).where(F.col(n) <= F.col(want)).select(*kept))


def looked_up(rows: DataFrame, small: DataFrame, on: list[str], few: int, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row a key: broadcast if that has few rows; else keys of many rows are salted."""
    if small.count() <= few:
        return rows.join(F.broadcast(small), on, how)
    salt = free_name("salt", rows, small)
    salted = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in rows.columns]), F.lit(SALTS)).cast("int")).join(salted, [*on, salt], how).drop(salt)


def quota(df: DataFrame, by: str, limit: int, key: Column, id_col: str) -> DataFrame:
    """At most limit rows of each group, chosen by hash. The limit is the operator's purpose."""
    return cut(df, by, F.lit(limit), key, id_col)


def top_up(df: DataFrame, by: str, target: int, key: Column, id_col: str, text: str) -> DataFrame:
    """target rows of each group: its own first, then those dressed anew, in turns; turn says in which."""
    many, group = free_name("many", df), free_name("group", df)
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias(many)).withColumnRenamed(by, group)
    copies = F.explode(F.sequence(F.lit(0), F.ceil(F.lit(target) / F.col(many)).cast("int") - 1)).alias("turn")
    rows = df.join(sizes, df[by].eqNullSafe(F.col(group))).select(*[F.col(quoted(c)) for c in df.columns if c != "turn"], copies)
    dressed = rows.withColumn(text, F.when(F.col("turn") == 0, F.col(text)).otherwise(X.vary(F.col(text), F.concat(key, F.lit("#"), F.col("turn")))))
    return cut(dressed, by, F.lit(target), key, id_col, tier=F.col("turn"))


def ordinal_split(df: DataFrame, key: Column, id_col: str, share: float) -> DataFrame:
    """is_val for the first share of rows, rounded down, in the order of the key's hash and then the id's.

    The bound is found level by level: counts by the next three digits of the hash say where it falls, until those beside it
    are few enough to be ranked; no step sorts all rows. Rows that share key and id share their fate's order at random.
    """
    h, r = free_name("hash", df), free_name("rank", df)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    hashed = df.withColumn(h, F.concat(F.sha1(text(key)), F.sha1(text(F.col(quoted(id_col))))))
    want, edge = None, ""
    while want is None or len(edge) < 80:
        here = hashed.where(F.col(h).startswith(edge)) if edge else hashed
        counts = here.groupBy(F.substring(h, len(edge) + 1, 3).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # 4096 at most
        if want is None:
            want = int(sum(c.n for c in counts) * share)
        for c in counts:
            if c.n > want:
                break
            want -= c.n
        else:  # all of them
            return hashed.withColumn("is_val", F.lit(bool(counts))).drop(h)
        edge += c.p
        if c.n <= EDGE_ROWS or not c.p:
            break
    part = F.substring(h, 1, len(edge))
    at_edge = hashed.where(part == edge).withColumn(r, F.row_number().over(W.orderBy(h, id_col)))
    rest = hashed.where(part != edge).withColumn("is_val", part < edge)
    return rest.unionByName(at_edge.withColumn("is_val", F.col(r) <= want).drop(r)).drop(h)


def leaks_exact(docs: DataFrame, held: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose text, trimmed and in small letters, is that of a held-out row."""
    digest = free_name("digest", docs)
    keys = held.select(F.sha1(X.dedup_key(F.col(text))).alias(digest)).distinct()
    return docs.join(keys, F.sha1(X.dedup_key(F.col(text))) == F.col(digest), "left_semi")


ANCHOR = 3
BLOCK_ITEMS = 10_000
BLOCK_BYTES = 64 << 20


def leaks_contained(docs: DataFrame, held: DataFrame, doc_id: str, item_id: str, text: str = "text", few: int = FEW_GROUPS) -> DataFrame:
    """(doc_id, item_id) where the document contains the item's text; null ids and texts are in no pair.

    An equi-join: three whole words within an item (its first and last may be parts of longer words) must stand in the
    document in a row. The items' words are broadcast if they are few; else words that very many documents hold are salted.
    Items of fewer than five words are compared with every document, a broadcast block of about BLOCK_ITEMS and BLOCK_BYTES at
    most at a time.
    """
    body, item, anchor, doc, at = "body", "item", "anchor", "doc", "at"
    texts = docs.select(F.col(quoted(doc_id)).alias(doc), F.col(quoted(text)).alias(body)).where("doc is not null and body is not null")
    words = F.split(body, " ", -1)
    items = held.select(F.col(quoted(item_id)).alias(at), F.col(quoted(text)).alias(item)).where("at is not null and item <> ''").withColumn("w", F.split(item, " ", -1))
    # the array beside itself, shifted: inside a lambda the split would be done anew for every word
    shifted = F.arrays_zip(*[F.slice(words, 1 + i, 1 << 30).alias(f"w{i}") for i in range(ANCHOR)])
    grams = F.array_distinct(F.transform(shifted, lambda t: F.xxhash64(F.concat_ws(" ", *[t.getField(f"w{i}") for i in range(ANCHOR)]))))
    spots = texts.select(doc, F.explode(grams).alias(anchor))
    long = items.where(F.size("w") >= ANCHOR + 2).select(at, item, F.xxhash64(F.array_join(F.slice("w", 2, ANCHOR), " ")).alias(anchor)).distinct()
    hits = looked_up(spots, long, [anchor], few).select(doc, at, item).distinct()
    found = hits.join(texts, doc).where(F.contains(F.col(body), F.col(item))).select(doc, at)
    short = fixed(items.where(F.size("w") < ANCHOR + 2).select(at, item).distinct())
    size = short.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(item)), F.lit(0)).alias("b")).first()
    blocks = -(-size.n // BLOCK_ITEMS) and max(-(-size.n // BLOCK_ITEMS), -(-size.b // BLOCK_BYTES))
    for i in range(blocks):
        block = short if blocks == 1 else short.where(F.pmod(F.xxhash64(item, at), F.lit(blocks)) == i)
        found = found.unionByName(texts.join(F.broadcast(block), F.contains(F.col(body), F.col(item))).select(doc, at))
    return found.distinct().select(F.col(doc).alias(doc_id), F.col(at).alias(item_id))
