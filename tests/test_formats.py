"""The two data sources: round trips, ranges, several folders, and writes of which a task is lost or a job fails."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomery.sources import formats as S
from loomery.sources.tables import read_jsonl

SCHEMA = "text string, symbols array<string>, n long"


@pytest.fixture
def known(spark):
    S.register(spark)
    return spark


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a\nb", 'quote "x"', "é日本", "", None, "x" * 300]), rng.choice([["<set>", "4"], [], None]), i) for i in range(n)]


def key(r):
    return tuple(map(str, r))


def test_lines_there_and_back(known, tmp_path, monkeypatch):
    many = rows(500)
    frame = known.createDataFrame(many, SCHEMA).repartition(3)
    frame.write.format("split_lines").option("split", "val").mode("append").save(str(tmp_path))
    read = lambda: known.read.format("split_lines").schema(SCHEMA).option("split", "val").load(str(tmp_path))
    assert sorted(map(key, read().collect())) == sorted(map(key, many))
    frame.limit(10).write.format("split_lines").option("split", "val").mode("append").save(str(tmp_path))
    assert read().count() == 510
    frame.limit(7).write.format("split_lines").option("split", "val").mode("overwrite").save(str(tmp_path))
    assert read().count() == 7
    assert [f for f in os.listdir(tmp_path) if f.startswith(".") and not f.endswith(".crc")] == []
    listed = {n for f in S.listing(str(tmp_path), "val") for n in f["names"]}
    assert {f for f in os.listdir(tmp_path) if f.endswith(".jsonl")} == listed


@pytest.mark.parametrize("step", [1, 7, 64, 1000])
def test_every_line_is_in_one_range(tmp_path, monkeypatch, step):
    many = ["{}", '{"n": 1}', "", '{"n": 22222222222}', '{"text": "' + "y" * 150 + '"}', '{"n": 3}']
    path = tmp_path / "x.jsonl"
    for data in ("\n".join(many), "\n".join(many) + "\n", "\n\n", ""):
        path.write_text(data)
        monkeypatch.setattr(S, "RANGE_BYTES", step)
        reader = S.LinesReader(None, [(str(path), len(data))])
        with open(path, "rb") as raw:
            f = pa.PythonFile(raw)
            got = b"".join(S.LinesReader._lines(f, p) for p in reader.partitions())
        assert got.decode() == data


def test_folders_in_order(known, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (b / "dev.jsonl").write_text('{"text": "b", "unknown": {"x": 1}}\n\n{"symbols": ["y"]}\n')
    (a / "test.jsonl").write_text('{"text": "a"}\n')
    (b / "test.jsonl").write_text('{"text": "not this"}\n')
    one = lambda split: [key(r) for r in read_jsonl(known, SCHEMA, str(a), str(b), split=split).collect()]
    assert one("dev") == [("b", "None", "None"), ("None", "['y']", "None")] and one("test") == [("a", "None", "None")]
    with pytest.raises(Exception, match="no val.jsonl"):
        read_jsonl(known, SCHEMA, str(a), str(b), split="val").collect()
    (a / "bad.jsonl").write_text('{"text": \n')
    with pytest.raises(Exception, match="(?i)json"):
        read_jsonl(known, SCHEMA, str(a), split="bad").collect()


def test_a_lost_task_leaves_nothing(tmp_path):
    """One attempt wrote and was lost, another counted: only its file stays."""
    writer = S.LinesWriter(str(tmp_path), "train", False)
    batch = pa.RecordBatch.from_pylist([{"text": "x", "n": 1}])
    writer.write(iter([batch]))  # lost: its message never comes
    kept = writer.write(iter([batch, batch]))
    assert S.listing(str(tmp_path), "train") is None  # nothing is to be seen before the commit
    writer.commit([kept, None])
    assert [(f["rows"], len(f["names"])) for f in S.listing(str(tmp_path), "train")] == [(2, 1)]
    files = [f for f in os.listdir(tmp_path) if f.endswith(".jsonl")]
    assert files == S.listing(str(tmp_path), "train")[0]["names"] and len((tmp_path / files[0]).read_text().splitlines()) == 2


def test_a_failed_job_changes_nothing(known, tmp_path):
    good = known.range(20).select(F.array_repeat(F.lit(5), 4).alias("tokens"), F.array_repeat(F.lit(1), 4).alias("mask")).repartition(4)
    good.write.format("token_matrix").option("width", 4).mode("overwrite").save(str(tmp_path))
    seen = lambda: sorted(f for f in os.listdir(tmp_path) if not f.startswith("."))  # noqa: E731  (a task may outlive its job)
    before = seen()
    bad = known.range(20).select(F.array_repeat(F.lit(5), F.when(F.col("id") == 7, 3).otherwise(4)).alias("tokens"), F.array_repeat(F.lit(1), 4).alias("mask")).repartition(4)
    for frame in (bad, good.withColumn("tokens", F.array_repeat(F.lit(70_000), 4)), good.withColumn("mask", F.array(*[F.lit(None).cast("int")] * 4))):
        with pytest.raises(Exception, match="wide|out of bounds"):
            frame.write.format("token_matrix").option("width", 4).mode("overwrite").save(str(tmp_path))
        assert seen() == before
    assert known.read.format("token_matrix").load(str(tmp_path)).count() == 20


def test_matrix_there_and_back(known, tmp_path, monkeypatch):
    many = [([i, 65_535, 0], [i % 2, 1, 255]) for i in range(300)]
    known.createDataFrame(many, S.MATRIX).repartition(3).write.format("token_matrix").option("width", 3).mode("append").save(str(tmp_path))
    got = [(r.tokens, r["mask"]) for r in known.read.format("token_matrix").load(str(tmp_path)).collect()]
    assert sorted(got) == sorted(many)
    assert sum(os.path.getsize(tmp_path / n) for f in S.listing(str(tmp_path), "matrix") for n in f["names"]) == 300 * 9
    assert json.loads((tmp_path / "matrix.files.json").read_text())["files"][0]["width"] == 3
