"""Run histories of three generations, their bests and spreads, and the guard over what is stored."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomery.operators import history as H

RUNS = {
    "a": {"cfg": {"dim": 64, "rope": True}, "params": 10, "seed": 1, "tok_fp": "f1", "best_val": 0.5, "history": [{"step": 0, "train": 2.0, "val": 1.5, "sym_acc": 0.1}, {"step": 10, "train": 1.0, "val": 0.5, "sym_acc": 0.7}, {"step": 20, "train": 0.9, "val": 0.75, "sym_acc": 0.6}]},
    "b": {"seed": 2, "tok_fp": "f1", "history": [{"iter": "0", "val_loss": "1.25"}, {"iter": "5", "val_loss": "n/a", "acc": "0.5"}, {"iter": "9", "val_loss": "1.0", "acc": 0.25, "note": "warm"}]},
    "c": {"history": []},
    "d": {"seed": 4, "tok_fp": "f2"},
}


@pytest.fixture
def folder(tmp_path):
    for name, run in RUNS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(run, indent=2))
    return str(tmp_path)


def test_steps_of_all_generations(spark, folder):
    rows = {(r.run, r.step): (r.train, r.val, r.sym_acc) for r in H.read_steps(spark, folder, True).collect()}
    assert rows == {
        ("a", 0): (2.0, 1.5, 0.1), ("a", 10): (1.0, 0.5, 0.7), ("a", 20): (0.9, 0.75, 0.6), ("b", 0): (None, 1.25, None), ("b", 5): (None, None, 0.5), ("b", 9): (None, 1.0, 0.25),
    }
    runs = {r.run: r for r in H.read_runs(spark, folder, True).collect()}
    assert set(runs) == set(RUNS) and runs["a"].cfg == {"dim": "64", "rope": "true"} and runs["c"].seed is None


def test_best_and_spread(spark, folder):
    steps = H.read_steps(spark, folder, True)
    best = {(r.run, r.step): r.best for r in H.best_so_far(steps).collect()}
    assert best == {("a", 0): 1.5, ("a", 10): 0.5, ("a", 20): 0.5, ("b", 0): 1.25, ("b", 5): 1.25, ("b", 9): 1.0}
    out = H.spread_of_best(steps, F.lit("all"), F.lit(100)).first()
    assert (out.n_runs, out.mean_rate, out.half_range) == (2, 0.75, 0.25)


def test_written_and_read_again(spark, tmp_path):
    steps = spark.createDataFrame([("r1", 2, 0.5), ("r1", 1, 0.75), ("r2", 1, None)], "run string, step int, val double")
    H.write_runs(steps, f"{tmp_path}/runs", tok_fp="x")
    assert sorted(map(tuple, H.read_steps(spark, f"{tmp_path}/runs").select("run", "step", "val").collect()), key=str) == [("r1", 1, 0.75), ("r1", 2, 0.5), ("r2", 1, None)]
    assert H.require_made_with(spark, f"{tmp_path}/runs", "x") == 2
    assert {r.run: r.best_val for r in H.read_runs(spark, f"{tmp_path}/runs").collect()} == {"r1": 0.5, "r2": None}


def test_the_guard(spark, folder):
    with pytest.raises(ValueError, match=r"2 of 4 runs were made with others than f1: c \(none\), d \(f2\)"):
        H.require_made_with(spark, folder, "f1", True)
    with pytest.raises(ValueError, match="no runs"):
        os.makedirs(f"{folder}/none")
        open(f"{folder}/none/x.json", "w").close()
        H.require_made_with(spark, f"{folder}/none", "f1")


def test_a_broken_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"history": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        H.read_steps(spark, str(tmp_path)).collect()
