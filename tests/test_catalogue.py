"""Every query with SQL gives DuckDB's rows; the others are held against plain Python."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomery.operators import generate as N
from loomery.functions import grammar as G
from loomery.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=repr)
    assert ours, "a check that compares nothing must not pass"
    assert ours == theirs


def test_bytes_round_trip(spark):
    rows = catalogue.bpe_encode(spark, SF)
    assert rows.count() > 100 and rows.where("not same").count() == 0


def test_generated_frames(spark):
    n = 20_000
    frames = N.frames(spark, n).cache()
    shares = {r.a: r["count"] / n for r in frames.groupBy(F.col("frame.action").alias("a")).count().collect()}
    total = sum(N.ACTION_WEIGHTS.values())
    for action, weight in N.ACTION_WEIGHTS.items():
        assert abs(shares[action] - weight / total) < 0.02
    f = F.col("frame")
    assert frames.where(~G.well_shaped(f)).count() == 0
    lines = frames.withColumn("line", F.array_join(G.to_symbols(f), " "))
    again = G.with_frame(lines, "line", "again")
    assert again.where(~G.frame_key(f).eqNullSafe(G.frame_key(F.col("again")))).count() == 0
    same = N.frames(spark, n).repartition(7).exceptAll(frames)
    assert same.count() == 0


def test_generated_corpus(spark):
    n = 3000
    rows = N.corpus(spark, n).cache()
    counts = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
    assert counts == N.quotas_of(n) and N.short(rows, n) == {}
    assert rows.count() == rows.select(F.lower(F.trim("text"))).distinct().count()
    assert rows.where("source <> 'template' and array_join(symbols, ' ') <> '<unknown> <end>'").count() == 0
    assert rows.where("source = 'template' and action = 'unknown'").count() == 0
    pool = spark.createDataFrame([(f"outside text {i}",) for i in range(20)] + [(None,), ("",)], "text string")
    far = N.corpus(spark, 1000, pools={"far": pool}).where("source = 'far'").collect()
    assert len(far) == N.quotas_of(1000)["far"] and sum(r.text in {f"outside text {i}" for i in range(20)} for r in far) == 20


def test_pins_and_intervals_are_out_of_bounds_as_said(spark):
    d = N.Draws(3)
    rows = spark.range(20_000).select(N.pin_number(d, "p").alias("p"), N.interval(d).alias("ms")).collect()
    legal = sum(r.p in G.PINS_S3 for r in rows) / len(rows)
    assert abs(legal - 0.82) < 0.01 and not set(N.NEAR_PINS) & set(G.PINS_S3)
    inside = sum(G.INTERVAL_MIN <= r.ms <= G.INTERVAL_MAX for r in rows) / len(rows)
    assert abs(inside - 0.9) < 0.01


def test_names_and_refusals_follow_their_shares(spark):
    from loomery.operators import vocabulary as V

    rows = N.negatives(spark.range(8000)).collect()
    total = sum(V.KINDS.values())
    for kind, weight in V.KINDS.items():
        assert abs(sum(r.generator == kind for r in rows) / len(rows) - weight / total) < 0.02
    assert not any("{" in r.text or not r.text for r in rows)
    names = spark.range(8000).select(N.name(N.Draws(1), "n").alias("n"), N.group_name(N.Draws(1), "g").alias("g")).collect()
    assert not any("{" in r.n + r.g for r in names) and len({r.n for r in names}) > 3000
    assert abs(sum(r.n.endswith(tuple("0123456789")) for r in names) / 8000 - 0.091) < 0.02


def test_whole_texts_are_packed(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomery.operators import pack as P

    tokenizer, width = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), catalogue.PACK_WIDTH
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [i + len(P.RESERVED) for i in tokenizer.encode(r.text or "", add_special_tokens=False).ids]
        room = width - 3
        for part in range(max(1, -(-len(ids) // room))):
            row = [*ids[part * room : (part + 1) * room], P.GO, 2 + r.doc_id % 7, 18]
            want[r.doc_id, part] = (",".join(map(str, row + [P.PAD] * (width - len(row)))), 2)
    got = {(r.doc_id, r.part): (r.tokens, r.masked) for r in catalogue.pack_whole_texts(spark, SF).collect()}
    assert got == want and max(part for _, part in got) > 0


def test_whole_tables_are_read(spark, tmp_path):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    assert catalogue.running_best(spark, SF).count() == read("events").count()
    assert sum(r.n for r in catalogue.run_split_matrix(spark, SF).collect()) == read("events").count()
    assert catalogue.positional_diff(spark, SF).first().lines == read("conversations").count()
    read("benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    planted = read("benchmark").limit(4).select((F.col("item_id") * 10 + 3).alias("doc_id"), F.lit("xx").alias("lang"), F.concat(F.lit(" "), F.upper("text")).alias("text"))
    read("documents").select("doc_id", "lang", "text").where("doc_id < 0").unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(r.leaked for r in catalogue.leak_exact(spark, str(tmp_path)).collect()) == 4


def test_many_short_items_are_all_searched(spark):
    from loomery.operators import curate as C

    items = [(i, f"w{i} x") for i in range(10_050)]
    texts = [(0, "a w7 x b w10049 x"), (1, "nothing"), (2, "w5000 xy and w70 xx"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in C.leaks_contained(docs, held, "doc_id", "item_id").collect()}
    assert got == {(d, i) for d, t in texts for i, item in items if t and item in t} and len(got) == 4


def test_frames_are_drawn_in_many_tasks(spark):
    """The events are one file of one row group; drawing costs more than reading."""
    rows = catalogue.QUERIES["generated_texts"](spark, SF)
    per_task = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per_task) > 1 and max(per_task) <= 2 * sum(per_task) / len(per_task)
