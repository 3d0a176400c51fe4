"""Places, permutations, digests, cuts of groups and checked writes against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomery.operators import curate as C
from loomery.operators import ordinals as O


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), i, "x") for i in range(3000)]
    frame = spark.createDataFrame(rows, "k int, i int, place string").repartition(7)
    for parts in (1, 5, 50):
        out = O.with_ordinal(frame, "k", "i", partitions=parts)
        assert out.columns == ["k", "i", "place"] and "SinglePartition" not in plan(out)
        got = {(r.k, r.i): r.place for r in out.collect()}
        assert got == {(k, i): n for n, (k, i, _) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}
    assert O.with_ordinal(frame.limit(0), "k").count() == 0
    same = O.with_ordinal(frame.select("k"), "k", out="n").select("n").collect()
    assert sorted(r.n for r in same) == list(range(1, 3001))


def test_a_shuffle_is_a_permutation(spark):
    frame = spark.range(500).withColumn("w", F.lit(1))
    a, b, c = ({r.id: r.place for r in O.shuffled(df, s, "id").collect()} for df, s in ((frame, 1), (frame.repartition(9), 1), (frame, 2)))
    assert a == b != c and sorted(a.values()) == list(range(1, 501))
    assert a == {i: n for n, (_, i) in enumerate(sorted((hashlib.sha1(f"1|{i}".encode()).hexdigest(), i) for i in range(500)), 1)}


def root(lines, fanout):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    nodes, depth = [sha("" if x is None else "=" + x) for x in lines], 0
    while len(nodes) > 1 or not depth:
        nodes, depth = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)], depth + 1
    return depth, nodes[0]


@pytest.mark.parametrize("n", [1, 3, 4, 5, 16, 17, 300])
def test_merkle_root(spark, n):
    lines = [f"line {i % 7}" if i % 5 else None for i in range(n)]
    frame = spark.createDataFrame(list(enumerate(lines)), "i int, s string")
    want = (n, *root(lines, 4))
    for parts, df in ((1, frame), (3, frame.repartition(4)), (29, frame.orderBy(F.desc("i")))):
        assert tuple(O.merkle_root(df, F.col("s"), "i", fanout=4, partitions=parts).first()) == want
    changed = frame.withColumn("s", F.when(F.col("i") == n - 1, "other").otherwise(F.col("s")))
    assert O.merkle_root(changed, F.col("s"), "i", fanout=4).first().root != want[2]
    assert tuple(O.merkle_root(frame.limit(0), F.col("s"), "i").first()) == (0, 0, "")


def test_contiguity(spark):
    for ids, want in (([0, 1, 2], True), ([2, 0, 1], True), ([], True), ([0], True), ([1, 2], False), ([0, 0, 1], False), ([0, 2], False), ([0, None, 1], False), ([None], False)):
        got = O.contiguous(spark.createDataFrame([(i,) for i in ids], "i int"), "i").first()
        assert (got.n, got.contiguous) == (len(ids), want), ids


def expected(rows, limit, tier=lambda r: 0):
    sha = lambda x: hashlib.sha1(("null" if x is None else str(x)).encode()).hexdigest()
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {g: sorted(own, key=lambda r: (tier(r), sha(r[2]), sha(r[1])))[: limit(g)] for g, own in groups.items()}


@pytest.mark.parametrize("edge_rows, few", [(100_000, 1000), (3, 1000), (1, 0)])
def test_cut(spark, edge_rows, few):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None, ""]), i, rng.choice([f"k{i}", "same", None]), rng.randrange(3)) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, id int, k string, cut_hash int").repartition(5)
    limit = {"hot": 250, "a": 1, "b": 10_000, None: 7, "": 0}
    column = F.lit(None).cast("int")
    for g, n in limit.items():
        column = F.when(F.col("g").eqNullSafe(F.lit(g)), n).otherwise(column)
    got = C.cut(frame, "g", column, F.col("k"), "id", edge_rows=edge_rows, few=few)
    assert got.columns == frame.columns
    want = expected(rows, lambda g: limit[g])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for own in want.values() for r in own)
    tiered = C.cut(frame, "g", F.lit(120), F.col("k"), "id", tier=F.col("cut_hash"), edge_rows=edge_rows, few=few)
    want = expected(rows, lambda g: 120, tier=lambda r: r[3])
    assert sorted(map(str, map(tuple, tiered.collect()))) == sorted(str(r) for own in want.values() for r in own)
    assert C.cut(frame.limit(0), "g", F.lit(5), F.col("k"), "id").count() == 0


def test_cut_of_repeated_rows(spark):
    frame = spark.createDataFrame([("g", 1, "k", 0)] * 50, "g string, id int, k string, x int")
    assert C.cut(frame, "g", F.lit(20), F.col("k"), "id", edge_rows=5).count() == 20
    assert C.quota(frame, "g", 80, F.col("k"), "id").count() == 50


def test_no_group_is_sorted_whole(spark):
    frame = spark.range(20_000).select((F.col("id") * 0).alias("g"), "id", F.col("id").cast("string").alias("k"))
    out = C.cut(frame, "g", F.lit(5000), F.col("k"), "id", edge_rows=50)
    assert out.count() == 5000
    ranked = [line for line in plan(out).split("\n") if "Window" in line]
    assert ranked and "Filter" in plan(out)


def test_checked_write(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"t{i}", 1) for i in range(40)], "id int, text string, said int").repartition(4)
    assert C.write_checked(frame, F.col("id") >= 0, F.lit("x"), "id", f"{tmp_path}/good") == 40
    ok = F.when(F.col("id") != 9, F.col("id") % 10 != 3)
    with pytest.raises(C.QuarantineError, match="5 of 40 rows are bad: no 3; no 9; no 13$"):
        C.write_checked(frame, ok, F.concat(F.lit("no "), F.col("id").cast("string")), "id", f"{tmp_path}/some", shown=3)
    both = spark.read.parquet(f"{tmp_path}/some")
    assert {r.id for r in both.where("quarantined = 'true'").collect()} == {3, 9, 13, 23, 33} and both.where("quarantined = 'false'").count() == 35
    assert C.write_checked(frame.limit(0), ok, F.lit("x"), "id", f"{tmp_path}/none") == 0


def test_a_checked_write_reads_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frame = spark.range(100).mapInArrow(counted, "id long")
    with pytest.raises(C.QuarantineError):
        C.write_checked(frame, F.col("id") != 5, F.lit("five"), "id", f"{tmp_path}/once")
    assert seen.value == 100


def test_report_in_one_pass(spark):
    frame = spark.createDataFrame([(i, None if i == 7 else i % 4) for i in range(30)], "id int, x int")
    good, report = C.quarantine(frame, F.col("x") != 0, F.concat(F.lit("row "), F.col("id").cast("string")), "id", 3)
    assert tuple(report.first()) == (9, ["row 0", "row 4", "row 7"]) and good.count() == 21
    _, none = C.quarantine(frame.limit(0), F.col("x") != 0, F.lit("x"), "id")
    assert tuple(none.first()) == (0, [])
