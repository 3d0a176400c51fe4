"""The alias tables as the state of a stream: restarts, an initial state, bounds, and the state read back as a table."""

import json
import random

import pytest

from loomery.streaming.aliases import alias_stream, step, stored_aliases

COMMANDS = "device long, event_id long, op string, name string, pins array<int>"


def put(folder, n, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps(dict(zip(("device", "event_id", "op", "name", "pins"), r))) for r in rows]
    (folder / f"part-{n}.json").write_text("\n".join(lines) + "\n")


def trigger(spark, folder, out, check, known=None):
    stream = spark.readStream.schema(COMMANDS).json(str(folder))
    query = alias_stream(stream, known).writeStream.format("parquet").option("checkpointLocation", str(check)).outputMode("append").trigger(availableNow=True).start(str(out))
    query.awaitTermination(120)
    assert query.exception() is None


def expected(rows, tables):
    out = []
    for device, event, op, name, pins in sorted(rows, key=lambda r: r[1]):
        ok, found = step(tables.setdefault(device, {}), op, name, pins)
        out.append((device, event, op, name, ok, len(tables[device]), found))
    return out


def commands(n, seed, first=0):
    rng = random.Random(seed)
    names = ["Lamp", "lamp ", "desk_lamp", "Fan", *[f"n{i}" for i in range(20)], "", None, "x" * 60]
    one = lambda i: (rng.randrange(3), first + i, rng.choice(["define", "define", "define", "forget", "look"]), rng.choice(names), rng.choice([[1], [2, 3], [], [1] * 7, None]))
    return [one(i) for i in range(n)]


def test_a_stream_that_is_started_again(spark, tmp_path):
    folder, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    known = spark.createDataFrame([(0, "Porch", [9]), (7, "Wall", [4, 5]), (7, "bad", [1] * 9)], "device long, name string, pins array<int>")
    tables = {0: {"porch": [9]}, 7: {"wall": [4, 5]}}
    first, second = commands(150, 1), commands(150, 2, 1000)
    put(folder, 0, first)
    trigger(spark, folder, out, check, known)
    want = expected(first, tables)
    put(folder, 1, second)
    trigger(spark, folder, out, check, known)  # a new query from the checkpoint: the initial state counts once
    want += expected(second, tables)
    rows = sorted(spark.read.parquet(str(out)).collect(), key=lambda r: r.event_id)
    assert [tuple(r) for r in rows] == sorted(want, key=lambda r: r[1])
    assert max(r.n_aliases for r in rows) == 16
    stored = {}
    for r in stored_aliases(spark, str(check)).orderBy("device", "place").collect():
        stored.setdefault(r.device, {})[r.name] = r.pins
    assert stored == {d: t for d, t in tables.items() if t} and [list(t) for t in stored.values()] == [list(tables[d]) for d in stored]


def test_a_table_is_one_trigger(spark):
    rows = commands(200, 3)
    frame = spark.createDataFrame(rows, COMMANDS).repartition(5)
    got = sorted(map(tuple, alias_stream(frame).collect()), key=lambda r: r[1])
    assert got == expected(rows, {})
    assert alias_stream(frame.limit(0)).count() == 0


def test_bounds():
    table = {}
    for i in range(16):
        assert step(table, "define", f"N{i}", [i])[0]
    assert step(table, "define", "one more", [1]) == (False, []) and step(table, "define", "n3", [40]) == (True, [40])
    assert step(table, "forget", "n0", None)[0] and list(table)[0] == "n15"
    with pytest.raises(ValueError):
        from loomery.streaming.aliases import restored

        restored(["a"], [[1] * 7])
