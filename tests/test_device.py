"""The board's state machine, its replay of a table and its stream."""

import pytest
from pyspark.sql import functions as F

from loomery.streaming.aliases import fold, restored, step
from loomery.streaming.device import SLOTS, Board, device_replay, device_stream

SCHEMA = "device long, event_id long, action string, pins array<int>, names array<string>, every boolean, level string, interval_ms int, rounds int"


def test_levels_and_slots():
    b = Board()
    assert b.run("set", [4, 5], [], level="high") == "execute" and b.high == {4, 5}
    assert b.run("set", [4], [], level="toggle") == "execute" and b.high == {5}
    assert b.run("blink", [5, 6], []) == "execute" and b.high == set()
    assert [s and (s["mode"], s["pins"], s["ms"], s["rounds"]) for s in b.slots[:3]] == [("blink", [5], 500, 0), ("blink", [6], 500, 0), None]
    assert b.run("seq", [5, 7], [], ms=None, rounds=2) == "execute"  # takes 5 from its blink
    assert [s and s["pins"] for s in b.slots[:2]] == [[5, 7], [6]] and b.high == {5} and b.slots[0]["ms"] == 200
    b.tick(0)
    assert b.high == {7}
    for _ in range(3):
        b.tick(0)
    assert b.slots[0] is None and b.high == set()  # two rounds are over
    assert b.run("set", [6], [], level="high") == "execute" and b.slots[1] is None  # a set wins over an animation
    assert b.run("set", [], [], every=True, level="high") == "execute" and b.high == set(b.pins)
    assert b.run("stop", [], []) == "execute" and b.high == set(b.pins)
    assert b.run("blink", [], [], every=True) == "cannot_blink_all"


def test_blink_rounds_and_busy_slots():
    b = Board()
    b.run("blink", [4], [], ms=100, rounds=1)
    b.tick(0)
    assert b.high == {4} and b.slots[0]
    b.tick(0)
    assert b.high == set() and b.slots[0] is None
    assert b.run("blink", b.pins[:SLOTS], []) == "execute"
    assert b.run("blink", [b.pins[SLOTS]], []) == "slots_busy" and b.run("seq", b.pins[9:11], []) == "slots_busy"
    assert b.run("stop", [b.pins[0]], []) == "execute" and b.free() == 0
    assert b.run("blink", [b.pins[1]], []) == "execute" and b.free() == 0  # its own slot again


def test_order_of_stages():
    b = Board()
    assert b.run("alias", [100], ["lamp"]) == "bad_pin" and not b.names
    assert b.run("set", [], ["Desk_Lamp"], level="high") == "unknown_name"
    assert b.run("alias", [4], ["Desk Lamp"]) == "execute" and b.run("set", [], ["desk-lamp"], level="high") == "execute" and b.high == {4}
    assert b.run("seq", [], ["desk lamp"]) == "name_too_few_pins"
    assert b.run("set", [100], ["nobody"], level="high") == "unknown_name"  # names come before pins
    assert b.run("blink", [100], [], ms=1) == "bad_pin" and b.run("blink", [4], [], ms=1) == "bad_interval"
    assert b.run("seq", b.pins[:7], []) == "too_many_pins" and b.run("unknown", [], []) == "unknown" and b.run(None, None, None) == "unknown"
    assert Board.restored(*b.stored()).stored() == b.stored()
    with pytest.raises(ValueError):
        Board.restored([], [], [1000], b.stored()[3])


def test_alias_table_bounds():
    table: dict = {}
    assert fold("A_b-\tC ") == "a b c" and fold("É") == "É"
    assert step(table, "define", None, [1]) == (False, []) and step(table, "define", "x", None) == (False, []) and step(table, "define", "x", []) == (False, [])
    assert step(table, "define", "x", [1] * 7) == (False, []) and step(table, "define", "x" * 49, [1]) == (False, []) and step(table, "define", "x", [1, None]) == (False, [])
    for i in range(16):
        assert step(table, "define", f"n{i}", [i])[0]
    assert not step(table, "define", "one more", [1])[0] and step(table, "define", "N3", [9]) == (True, [9])
    assert step(table, "forget", "n1", None)[0] and list(table)[1] == "n15" and len(table) == 15
    assert step(table, "forget", "n14", None)[0] and not step(table, "forget", "n14", None)[0]
    with pytest.raises(ValueError):
        restored(["a"], [])


def commands(spark):
    rows = [(d, i, a, p, n, e, lv, ms, r) for d in (1, 2, None) for i, (a, p, n, e, lv, ms, r) in enumerate([
        ("alias", [4], ["lamp"], False, None, None, None), ("blink", [], ["Lamp"], False, None, None, 3), ("set", [4], None, False, "high", None, None),
        ("seq", [5, 6], [], None, None, 300, None), ("stop", [], [], False, None, None, None), ("set", [99], [], False, "high", None, None),
    ])]
    return spark.createDataFrame(rows, SCHEMA)


WANT = [("execute", 0, []), ("execute", 1, []), ("execute", 0, [4]), ("execute", 1, [4, 5]), ("execute", 0, [4]), ("bad_pin", 0, [4])]


def test_replay(spark):
    df = commands(spark)
    out = device_replay(df.where("device is not null").orderBy(F.desc("event_id")).unionByName(df.where("device is null")))
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.event_id):
        got.setdefault(r.device, []).append((r.verdict, r.busy_slots, r.high_pins))
    assert got[1] == got[2] == WANT and len(got) == 3
    assert device_replay(df.limit(0)).count() == 0


def test_stream_equals_replay(spark, tmp_path):
    df = commands(spark).where("device is not null")
    for part, where in enumerate(("event_id < 3", "event_id >= 3")):
        df.where(where).write.json(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1000).json(f"{tmp_path}/in/0")
    query = device_stream(stream).writeStream.format("memory").queryName("boards").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination()
    got = sorted((r.device, r.event_id, r.verdict, r.busy_slots) for r in spark.table("boards").collect())
    assert got == sorted((d, i, *WANT[i][:2]) for d in (1, 2) for i in range(3))
