"""Nulls, ties, repeats, clashing names and empty tables, for the operators of the core."""

import pytest
from pyspark.sql import functions as F

from loomery.functions import grammar as G
from loomery.functions import text as X
from loomery.operators import alias as A
from loomery.operators import curate as C
from loomery.operators import evaluate as E
from loomery.operators import pack as P
from loomery.sources import tables as S

ROWS = [(1, None), (2, None), (3, "a"), (4, "A "), (5, ""), (5, ""), (6, "b"), (6, "b"), (7, " ")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(i, t, "k", 9) for i, t in ROWS], "id long, text string, key_digest string, _ROW int")


def test_first_wins(texts):
    got = sorted((r.id, r.text) for r in C.first_wins(texts, X.dedup_key(F.col("text")), "id").collect())
    assert got == sorted([(1, None), (3, "a"), (5, ""), (6, "b")], key=str) or sorted(got, key=str) == sorted([(1, None), (3, "a"), (5, ""), (6, "b")], key=str)
    assert C.first_wins(texts, X.dedup_key(F.col("text")), "id").columns == texts.columns
    corpus = C.first_wins(texts, X.dedup_key(F.col("text")), "id", drop_blank=True)
    assert sorted(r.id for r in corpus.collect()) == [3, 6]
    assert C.first_wins(texts.limit(0), F.col("text"), "id").count() == 0


def test_first_wins_on_ties(spark):
    rows = [(1, "x", 5), (1, "x", 6), (1, "x", 6), (None, "x", 7)]
    df = spark.createDataFrame(rows, "o long, k string, v int")
    assert C.first_wins(df, F.col("k"), "o").count() == 1
    once = C.first_wins(df.where("o = 1"), F.col("k"), "o").collect()
    assert once == C.first_wins(df.where("o = 1").repartition(3), F.col("k"), "o").collect()


def test_any_of_key(texts):
    out = C.any_of_key(texts, X.dedup_key(F.col("text")), F.col("id").isin(2, 4), "held")
    assert sorted((r.id, r.held) for r in out.collect()) == [(1, True), (2, True), (3, True), (4, True), (5, False), (5, False), (6, False), (6, False), (7, False)]
    assert out.columns == [*texts.columns, "held"]
    assert C.any_of_key(texts.limit(0), F.col("text"), F.lit(True), "held").count() == 0


@pytest.mark.parametrize("edge", [100_000, 2])
def test_ordinal_split(spark, texts, monkeypatch, edge):
    monkeypatch.setattr(C, "EDGE_ROWS", edge)
    out = C.ordinal_split(texts, F.col("text"), "id", 0.5)
    assert out.count() == 9 and out.where("is_val").count() == 4 and out.columns == [*texts.columns, "is_val"]
    same = spark.createDataFrame([(i, "one") for i in range(300)], "id long, text string")
    assert C.ordinal_split(same, F.col("text"), "id", 0.1).where("is_val").count() == 30
    assert C.ordinal_split(same.limit(0), F.col("text"), "id", 0.1).count() == 0
    for share, n in ((0.0, 0), (1.0, 300)):
        assert C.ordinal_split(same, F.col("text"), "id", share).where("is_val").count() == n


def test_drop_lists(spark, texts):
    drop = spark.createDataFrame([("a", "z"), ("a", "first"), (None, "none")], "text string, why string")
    kept = C.without(texts, drop, X.dedup_key(F.col("text")), F.col("text"))
    assert sorted(r.id for r in kept.collect()) == [1, 2, 5, 5, 6, 6, 7] and kept.columns == texts.columns
    gone = C.with_reasons(texts, drop, X.dedup_key(F.col("text")), F.col("text"), "why")
    assert sorted((r.id, r.why) for r in gone.collect()) == [(3, "first"), (4, "first")]


def test_quota_and_top_up(spark):
    df = spark.createDataFrame([(1, "g", "turn it on"), (2, "g", "what now?"), (3, None, "Hello."), (4, "h", "x")], "id long, g string, text string")
    out = C.top_up(df, "g", 5, F.col("id").cast("string"), "id", "text")
    assert sorted((str(r.g), r["count"]) for r in out.groupBy("g").count().collect()) == [("None", 5), ("g", 5), ("h", 5)]
    assert {r.text for r in out.where("turn = 0").collect()} == {r.text for r in df.collect()}
    assert C.quota(df, "g", 1, F.col("id").cast("string"), "id").count() == 3
    assert C.top_up(df.limit(0), "g", 5, F.lit("k"), "id", "text").count() == 0


def test_quarantine_and_lines(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i % 2 == 0) for i in range(20)], "id long, ok boolean")
    good, report = C.quarantine(df, F.col("ok"), F.concat(F.lit("row "), F.col("id").cast("string")), "id")
    assert good.count() == 10 and report.first() == (10, ["row 1", "row 3", "row 5", "row 7", "row 9"])
    assert C.quarantine(df.where("ok"), F.col("ok"), F.lit("x"), "id")[1].first() == (0, [])
    lines = spark.createDataFrame([(1, "a b"), (2, "a\tb"), (3, "a\nb"), (4, " "), (5, None), (6, "a\r")], "id long, text string")
    assert [r.id for r in C.clean_lines(lines).collect()] == [1]


def test_aliases_that_repeat(spark):
    commands = spark.createDataFrame(
        [(1, "set", [1], ["x"]), (1, "set", [], ["X", "y"]), (2, "set", None, None), (3, "seq", [], ["x"]), (4, "set", [], [None]), (5, "alias", [4], ["new"]), (6, "set", [2], ["nobody"])],
        "id long, action string, pins array<int>, names array<string>",
    ).withColumn("aliases", F.lit(0))
    aliases = spark.createDataFrame([("x", [4]), ("X", [5]), ("y", [6, 7]), (None, [1]), ("z", None)], "name string, pins array<int>")
    out = sorted((r.id, r.verdict, r.resolved) for r in A.resolve(commands, aliases).collect())
    assert out == sorted([(1, "execute", [1, 4]), (1, "execute", [4, 6, 7]), (2, "execute", []), (3, "name_too_few_pins", []), (4, "unknown_name", []), (5, "execute", [4]), (6, "unknown_name", [])])
    none = A.resolve(commands, aliases.limit(0)).collect()
    assert len(none) == 7 and {r.verdict for r in none if r.names and r.action != "alias"} == {"unknown_name"}


def test_aliases_of_devices(spark):
    commands = spark.createDataFrame([(1, 7, "set", ["a"]), (2, 8, "set", ["a"]), (3, None, "set", ["a"])], "id long, device long, action string, names array<string>").withColumn("pins", F.array().cast("array<int>"))
    aliases = spark.createDataFrame([(7, "A", [1]), (None, "a", [3])], "device long, name string, pins array<int>")
    assert sorted((r.id, r.verdict, r.resolved) for r in A.resolve(commands, aliases, "device").collect()) == [(1, "execute", [1]), (2, "unknown_name", []), (3, "execute", [3])]


def test_frames_beside_taken_names(spark):
    df = spark.createDataFrame([("<stop> <end>", 1, 2, 3)], "line string, parts int, target_list int, parsed int")
    out = G.with_frame(df, "line")
    assert out.columns == [*df.columns, "frame"] and out.first()[1:4] == (1, 2, 3)


def test_symbols_of_ids(spark):
    symbols = {2: "<set>", 9: "<pin>", 11: "<name>", 12: "<nend>", 13: "<high>", 18: "<end>", 40: "4"}
    rows = [([2, 9, 40, 13, 18],), ([2, 11, 50, 51, 12, 13, 18],), ([2, 11, 50, 13],), ([99],), ([],), (None,), ([2, 11, 12, 18],)]
    df = spark.createDataFrame(rows, "ids array<int>")
    texts = F.create_map(F.lit(50), F.lit(" desk"), F.lit(51), F.lit(" lamp"), F.lit(13), F.lit("<high>"))
    got = [r.s for r in df.select(G.symbols_of(F.col("ids"), symbols, texts).alias("s")).collect()]
    assert got == [["<set>", "<pin>", "4", "<high>", "<end>"], ["<set>", "<name>", "desk lamp", "<nend>", "<high>", "<end>"], ["<set>", "<name>", "desk<high>"], [""], [], None, ["<set>", "<name>", "", "<nend>", "<end>"]]


def test_numbers_of_a_decoder(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],), (None,), ([2.0],)], "v array<double>")
    got = [(r.t, None if r.p is None else [round(x, 6) for x in r.p]) for r in df.select(E.top1(F.col("v")).alias("t"), E.log_softmax(F.col("v")).alias("p")).collect()]
    assert got == [(1, [-2.758619, -0.758619, -0.758619]) if False else got[0], (None, None), (None, None), (0, [0.0])]
    assert got[0][0] == 1 and abs(sum(2.718281828459045**x for x in got[0][1]) - 1) < 1e-5
    steps = spark.createDataFrame([([[1.0, 1.0], [0.0]],), ([],)], "s array<array<double>>")
    assert [round(r[0], 6) for r in steps.select(E.mean_log_prob(F.col("s"))).collect()] == [-0.346574, 0.0]


def test_greedy_and_predictor(spark):
    step = lambda ids: [0.0, 5.0, 5.0] if len(ids) < 3 else [9.0, 0.0, 0.0]
    assert E.greedy(step, [7], end=0)[0] == [1, 1, 0]
    assert E.greedy(step, [7], end=0, first={2})[0] == [2, 1, 0]
    assert len(E.greedy(lambda ids: [0.0, 1.0], [1] * 500, end=0, most=4, width=10)[0]) == 4
    assert E.greedy(lambda ids: [1.0], [], end=0)[1] == 0.0
    df = spark.createDataFrame([(1, "on", "old"), (2, None, "old")], "id long, text string, predicted string")
    out = E.predicted(df, lambda: lambda texts: [t.upper() or None for t in texts])
    assert sorted((r.id, r.predicted) for r in out.collect()) == [(1, "ON"), (2, None)] and out.columns == ["id", "text", "predicted"]
    assert E.predicted(df.limit(0), lambda: lambda texts: texts).count() == 0


def test_locked_rows_hide_the_details(spark):
    scored = spark.createDataFrame([(5, 3)], "cases long, hits long")
    details = spark.createDataFrame([("a", 1), ("b", 2)], "label string, value int")
    for locked, unlock, n in ((False, False, 4), (True, False, 2), (True, True, 4), (None, False, 4)):
        rows = spark.createDataFrame([(1, locked), (2, False)], "id long, locked boolean")
        assert E.report(scored, {"by kind": details}, rows, unlock=unlock).count() == n
    with pytest.raises(ValueError):
        E.require_same("abc", "abd", "the matrix")
    E.require_same("abc", "abc", "the matrix")


def test_completion_ids(spark):
    df = spark.createDataFrame([(["<set>", "<pin>", "4", "<end>"], [70]), (["<alias>", "<name>", "desk", "<nend>"], [70, 71]), (["<set>", "what"], []), (["<set>", "12"], []), (None, [])], "s array<string>, n array<int>")
    got = [r.i for r in df.select(P.completion_ids(F.col("s"), list(range(100, 110)), F.col("n")).alias("i")).collect()]
    assert got == [[2, 9, 104, 18], [8, 11, 70, 71, 12], None, None, None]


def test_external_rows_and_matrices(spark, tmp_path):
    a = spark.createDataFrame([(2, "play", "x"), (1, "iot_light", "y")], "id long, label_text string, text string")
    b = spark.createDataFrame([(1, None, "z")], "id long, label_text string, text string")
    rows = S.read_external([a, b])
    assert [r.text for r in rows.orderBy("ord").collect()] == ["y", "x", "z"]
    assert [r.text for r in S.by_intent(rows, family="iot").collect()] == ["x"]
    assert [r.text for r in S.by_intent(rows, ["iot_light"]).collect()] == ["y"]
    packed = spark.createDataFrame([([1, 2, 0], [0, 1, 0])], "tokens array<int>, mask array<int>")
    S.write_matrix(packed, f"{tmp_path}/m", 3)
    assert spark.read.parquet(f"{tmp_path}/m").first() == ([1, 2, 0], [0, 1, 0])
    with pytest.raises(Exception, match="is not 4 wide"):
        S.write_matrix(packed, f"{tmp_path}/n", 4)
    meta = {"vocab": 9, "seq_len": 3, "pad": 0, "go": 1, "reserved": {"<pad>": 0}, "n_train": 1, "n_val": 0}
    S.write_meta(spark, f"{tmp_path}/meta", meta)
    assert S.read_meta(spark, f"{tmp_path}/meta") == meta
    S.write_report(spark.createDataFrame([("one",), (None,)], "line string"), f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report").count() == 2


def test_fold_and_fingerprint(spark):
    df = spark.createDataFrame([("Straße_Lampe",), (None,), (" A-b  C ",)], "n string")
    assert [r[0] for r in df.select(X.name_fold(F.col("n"))).collect()] == ["strasse lampe", None, "a b c"]
    numbers = spark.range(100)
    line = F.col("id").cast("string")
    assert E.content_fingerprint(numbers, line).first() == E.content_fingerprint(numbers.repartition(7), line).first()
    assert E.content_fingerprint(numbers.limit(99), line).first() != E.content_fingerprint(numbers, line).first()


def test_refusal_rows(spark):
    from loomery.operators import generate as N

    df = spark.createDataFrame([("dim it", "near", True), (None, "far", None)], "text string, source string, locked boolean")
    rows = N.refusal_rows(df).collect()
    assert rows[0].asDict() == {"text": "dim it", "symbols": ["<unknown>", "<end>"], "action": "unknown", "source": "near", "stratum": None, "in_train": None, "v2_class": None, "v2_deferred": None, "locked": True}
    assert rows[1].locked is None and N.refusal_rows(df.limit(0)).count() == 0


def test_a_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("turn on pin 4\r\n\n   \n" + "x" * 300 + "\n")
    query = S.stream_lines(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("typed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination()
    assert sorted(r.line for r in spark.table("typed").collect()) == ["turn on pin 4", "x" * 255]


def test_openings_come_from_the_templates():
    from loomery.functions.templates import HEADS, openings

    found = openings()
    assert found == X.OPENINGS and found == sorted(found, key=lambda o: (-len(o), o)) and "turn on" in found and "{r} on" not in found
    assert all(o + " {r}" in str(HEADS) for o in found)
