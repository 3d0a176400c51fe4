"""Golden cases of grammar, outcomes, names, keys and intervals."""

import pytest
from pyspark.sql import functions as F

from loomery.functions import grammar as G
from loomery.functions import text as X
from loomery.operators import alias as A
from loomery.operators import evaluate as E

COMMANDS = [
    ("<set> <pin> 1 0 0 <high> <end>", "bad_pin"), ("<set> <pin> 4 <pin> 5 <high> <end>", "execute"), ("<set> <pin> 4 <end>", None),
    ("<set> <all> <pin> 4 <high> <end>", None), ("<blink> <pin> 4 <cnt> 5 <end>", "execute"), ("<blink> <pin> 4 <int> 5 0 0 <end>", None),
    ("<blink> <pin> 4 <int> 4 9 <cnt> 0 <end>", "bad_interval"), ("<blink> <pin> 4 <int> 5 0 <cnt> 0 <end>", "execute"),
    ("<blink> <pin> 1 0 0 <int> 1 <cnt> 0 <end>", "bad_pin"), ("<seq> <pin> 4 <end>", None), ("<seq> <name> porch lights <nend> <end>", "execute"),
    ("<seq>" + "".join(f" <pin> {i}" for i in range(1, 8)) + " <end>", "too_many_pins"), ("<stop> <end>", "execute"), ("<stop> <all> <end>", None),
    ("<alias> <pin> 4 <name> desk lamp <nend> <end>", "execute"), ("<unknown> <pin> 4 <end>", None), ("<unknown> <end>", "execute"),
    ("<read> <pin> 1 2 3 4 5 6 7 <end>", None), ("", None),
]
HIGH4 = "<set> <pin> 4 <high> <end>"


def test_parse_and_range(spark):
    rows = spark.createDataFrame(COMMANDS + [(None, None)], "line string, want string")
    out = G.with_frame(rows, "line").select("line", "want", F.when(F.col("frame").isNotNull(), G.range_verdict(F.col("frame"))).alias("got")).collect()
    assert [(r.line, r.got) for r in out] == [(r.line, r.want) for r in out]


@pytest.mark.parametrize(
    ("gold", "got", "want", "accepted", "substituted"),
    [
        (HIGH4, HIGH4, "correct", False, False), (HIGH4, "broken", "refused", False, False), (HIGH4, "<unknown> <end>", "refused", False, False),
        (HIGH4, "<set> <pin> 1 0 0 <high> <end>", "refused_by_range", False, False), (HIGH4, "<set> <name> lmp <nend> <high> <end>", "refused_by_name", False, False),
        (HIGH4, "<set> <pin> 5 <high> <end>", "wrong_action", False, False), ("<unknown> <end>", "<set> <pin> 5 <high> <end>", "wrong_action", True, False),
        ("<unknown> <end>", "<set> <name> x <nend> <high> <end>", "refused_by_name", True, False),
        ("<set> <pin> 1 0 0 <high> <end>", "<set> <pin> 1 0 <high> <end>", "wrong_action", False, True),
    ],
)
def test_outcomes(spark, gold, got, want, accepted, substituted):
    rows = spark.createDataFrame([(gold, got)], "g string, p string")
    r = E.judged(G.with_frame(G.with_frame(rows, "g", "gold"), "p", "got")).collect()[0]
    assert (r.outcome, r.false_accept, r.substituted) == (want, accepted, substituted)


def test_aliases(spark):
    table = spark.createDataFrame([("desk lamp", [4]), ("status led", [2]), ("porch lights", [5, 6, 7, 8])], "name string, pins array<int>")
    cases = [
        (1, "set", [], ["Desk_Lamp"], "execute", [4]), (2, "set", [], ["aquarium pump"], "unknown_name", []), (3, "set", [9], ["desk lamp"], "execute", [9, 4]),
        (4, "seq", [], ["desk lamp"], "name_too_few_pins", []), (5, "set", [], ["desk lamp", "nope"], "unknown_name", []), (6, "alias", [4], ["new one"], "execute", [4]),
        (7, "set", list(range(14)), ["porch-lights"], "too_many_pins", []), (8, "stop", [], [], "execute", []),
    ]
    rows = spark.createDataFrame([c[:4] for c in cases], "id int, action string, pins array<int>, names array<string>")
    got = {r.id: (r.verdict, r.resolved) for r in A.resolve(rows, table).collect()}
    assert got == {c[0]: c[4:] for c in cases}


def test_keys(spark):
    base = "turn down the lights in the living room"
    texts = [(base, 7), (f"please {base}", 7), (f"so {base}", 6), (f"{base} please.", 2), ("Dim the lights.", 3), ("locked:dim the lights", 3), ("locked:please dim the lights", 7)]
    rows = spark.createDataFrame(texts, "t string, want int").withColumn("got", X.bucket10(X.partition_key(F.col("t")))).collect()
    assert [(r.t, r.got) for r in rows] == texts
    dressed = [(h + base + t + m,) for h in X.VARY_PREFIX for t in X.VARY_SUFFIX for m in ("", "?", ".", "!")]
    frame = spark.createDataFrame(dressed, "t string")
    assert frame.select(X.partition_key(F.col("t"))).distinct().count() > 1
    assert frame.select(X.partition_key_stable(F.col("t"))).distinct().count() == 1


def test_wilson(spark):
    want = {(0, 0): (0, 0, 0), (0, 21): (0, 0, 0.154644), (2, 200): (0.01, 0.002747, 0.035722), (100, 200): (0.5, 0.43136, 0.56864), (150, 150): (1, 0.975029, 1)}
    rows = E.with_interval(spark.createDataFrame(list(want), "k long, n long"), "k", "n").collect()
    assert {(r.k, r.n): tuple(round(x, 6) for x in (r.rate, r.low, r.high)) for r in rows} == want


def test_alias_stream(spark, tmp_path):
    from loomery.streaming.aliases import alias_stream

    rows = [(1, 1, "define", "Desk Lamp", [4]), (1, 2, "look", "desk_lamp", []), (2, 3, "look", "desk lamp", []), (1, 4, "forget", "DESK-LAMP", []), (1, 5, "look", "desk lamp", [])]
    rows += [(3, 10 + i, "define", f"n{i}", [i]) for i in range(18)]
    schema = "device long, event_id long, op string, name string, pins array<int>"
    spark.createDataFrame(rows, schema).write.json(f"{tmp_path}/in")
    q = alias_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in")).writeStream.format("memory").queryName("answers").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: (r.ok, r.n_aliases, r.pins) for r in spark.table("answers").collect()}
    assert got[1] == (True, 1, [4]) and got[2] == (True, 1, [4]) and got[3] == (False, 0, []) and got[4] == (True, 0, []) and got[5] == (False, 0, [])
    assert got[25] == (True, 16, [15]) and got[26] == (False, 16, [])


def test_sources(spark, tmp_path):
    from loomery.sources import tables as S

    rows = spark.createDataFrame([("a", ["<stop>", "<end>"], "stop", "template", "train"), ("b", ["<stop>", "<end>"], "stop", "template", "val")], S.CORPUS_SCHEMA)
    S.write_corpus(rows, f"{tmp_path}/corpus")
    assert spark.read.schema(S.CORPUS_SCHEMA).json(f"{tmp_path}/corpus").where("split = 'val'").count() == 1
    (tmp_path / "val.jsonl").write_text('{"text": "x", "symbols": ["<stop>"], "action": "stop"}\n')
    assert S.read_jsonl(spark, S.CORPUS_SCHEMA, f"{tmp_path}/none", str(tmp_path), split="val").collect()[0].text == "x"
    (tmp_path / "words.txt").write_text("# words\n\n" + "\n".join(f"w{i}\t{i}" if i % 2 else f"w{i}" for i in range(1200)))
    words = S.read_words(spark, f"{tmp_path}/words.txt")
    assert words.count() == 1200 and words.where("weight is null").count() == 600
    with pytest.raises(ValueError):
        S.read_words(spark, f"{tmp_path}/words.txt", 5000)
    with pytest.raises(ValueError):
        S.require_rows(words.limit(0), "words")
    with pytest.raises(FileNotFoundError):
        S.read_jsonl(spark, S.CORPUS_SCHEMA, f"{tmp_path}/none", split="val")
