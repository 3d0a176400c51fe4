"""Places of rows in an order of the whole table, permutations, and digests of ordered tables, none of them in one task.

Rows are range-partitioned and sorted, their partition and place in it are fixed by a reliable checkpoint, and the partitions'
counts, one number each, are added up before them.

Defined results: nulls come first; rows that are equal in all of the order's columns are in one partition and take their
places by a hash of all columns, so give a full key; extra columns stay; empty tables give empty ones.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions.columns import free_name, quoted
from loomery.sources.scratch import fixed

LOCAL_BITS = 33  # of monotonically_increasing_id, for the place within a partition
FANOUT = 64


def with_ordinal(df: DataFrame, *order: str | Column, out: str = "place", partitions: int | None = None) -> DataFrame:
    """df with each row's place, from 1, in an order of all rows. A column of that name is replaced."""
    spark = df.sparkSession
    mark, part, before = (free_name(c, df) for c in ("mark", "part", "before"))
    columns = [F.col(quoted(c)) for c in df.columns if c != out]
    by = [F.col(quoted(c)) if isinstance(c, str) else c for c in order]
    many = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(many, *by).sortWithinPartitions(*by, F.xxhash64(*[F.col(quoted(c)) for c in df.columns]))
    rows = fixed(ranged.select(*columns, F.monotonically_increasing_id().alias(mark)))
    number = F.shiftright(mark, LOCAL_BITS)
    counts = sorted(tuple(r) for r in rows.groupBy(number.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    starts = zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0))
    offsets = F.broadcast(spark.createDataFrame(list(starts), f"`{part}` long, `{before}` long"))
    place = F.col(before) + F.col(mark).bitwiseAND((1 << LOCAL_BITS) - 1) + 1
    return rows.join(offsets, number == F.col(part)).select(*columns, place.alias(out))


def shuffled(df: DataFrame, seed: int, key: str, out: str = "place", partitions: int | None = None) -> DataFrame:
    """df with each row's place in a permutation that a seed and the rows' keys decide, in any partitioning."""
    return with_ordinal(df, F.sha1(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")))), key, out=out, partitions=partitions)


def merkle_root(df: DataFrame, line: Column, *order: str | Column, fanout: int = FANOUT, partitions: int | None = None) -> DataFrame:
    """(n, depth, root): the digest of a table's lines in order, of any size.

    Leaves are the SHA-256 of the lines, at their places in the whole order. A node is the SHA-256 of its children's digests,
    fanout of them at most, in hexadecimal and in order; levels are added until one node is left. So the root depends on the
    lines and their order alone. Rows that share the order's columns are ordered by their lines' digests. An empty table has
    the root ''; a null line is not an empty one.
    """
    spark = df.sparkSession
    leaf = F.sha2(F.coalesce(F.concat(F.lit("="), line.cast("string")), F.lit("")), 256)
    names = [f"o{i}" for i in range(len(order))]
    keys = [F.col(quoted(c)) if isinstance(c, str) else c for c in order]
    nodes = with_ordinal(df.select(*[k.alias(n) for k, n in zip(keys, names)], leaf.alias("digest")), *names, "digest", partitions=partitions)
    nodes = nodes.select((F.col("place") - 1).alias("place"), "digest")
    n, depth = nodes.count(), 0
    if not n:
        return spark.createDataFrame([(0, 0, "")], "n long, depth int, root string")
    width = n
    while width > 1 or not depth:
        up = nodes.groupBy(F.expr(f"place div {fanout}").alias("place"))
        nodes = up.agg(F.expr("sha2(listagg(digest) within group (order by place), 256)").alias("digest"))
        width, depth = -(-width // fanout), depth + 1
    return nodes.select(F.lit(n).cast("long").alias("n"), F.lit(depth).alias("depth"), F.col("digest").alias("root"))


def contiguous(df: DataFrame, ids: str) -> DataFrame:
    """(n, contiguous): are the ids 0 to n - 1, each once? By counts and bounds, so no list of them is made."""
    i = F.col(quoted(ids))
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(i).alias("distinct"), F.min(i).alias("low"), F.max(i).alias("high"))
    whole = (F.col("n") == F.col("distinct")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return counts.select("n", F.when(F.col("n") == 0, True).otherwise(F.coalesce(whole, F.lit(False))).alias("contiguous"))
