import pytest

from loomery.llm.sharding import lookup_table, place, shard_names


def test_table_is_full_even_and_stable():
    names = shard_names(13)
    table = lookup_table(names, 1009)
    counts = [table.count(i) for i in range(13)]
    assert sum(counts) == 1009 and max(counts) - min(counts) <= 1
    fewer = lookup_table(names[:-1], 1009)
    moved = sum(1 for a, b in zip(table, fewer) if a != b and a != 12)
    assert moved < 0.25 * 1009


def test_table_equals_a_plain_restatement():
    from loomery.llm.sharding import _draw

    names, size = ["a", "b", "c"], 31
    prefer = {n: [(_draw(f"offset:{n}", size) + j * (1 + _draw(f"step:{n}", size - 1))) % size for j in range(size)] for n in names}
    owner = {}
    while len(owner) < size:
        for n in names:
            if len(owner) < size:
                owner[next(s for s in prefer[n] if s not in owner)] = n
    assert [names[i] for i in lookup_table(names, size)] == [owner[s] for s in range(size)]


def test_weights_and_refusals():
    table = lookup_table(["x", "y"], 101, [3, 1])
    assert 70 <= table.count(0) <= 80
    for bad in ((["x"], 100), (["x", "x"], 101), ([], 101)):
        with pytest.raises(ValueError):
            lookup_table(*bad)


def test_place(spark):
    rows = [(i % 50, "s") for i in range(200)] + [(None, "s"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, shard string")
    out = place(frame, "doc_id", shard_names(7), 101)
    assert out.columns == ["doc_id", "shard", "slot", "_shard", "shard_name"]
    got = out.collect()
    table = lookup_table(shard_names(7), 101)
    assert len(got) == 202 and all(table[r.slot] == r._shard for r in got)
    assert len({(r.doc_id, r._shard) for r in got}) == 51
    assert place(frame.limit(0), "doc_id", shard_names(7), 101).count() == 0
