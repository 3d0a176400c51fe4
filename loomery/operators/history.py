"""Histories of training runs: JSON files with nested steps, of several generations, as tables; bests, spreads and a guard.

A file holds one run: settings, and a list of steps with their numbers. Generations differ: fields are missing, renamed, or
numbers are written as text. A step is read as a map from name to text and each number is looked for under all its names.

Defined results: what is not there, or is no number, is null; a step without a number is kept with a null step and comes
first; steps that repeat are kept; a file without steps has a run and no steps; a file that is no JSON is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions.columns import quoted
from loomery.operators.evaluate import spread

#: The names that a number of a step has had.
NAMES = {"step": ["step", "iter"], "train": ["train", "train_loss", "loss"], "val": ["val", "val_loss"], "sym_acc": ["sym_acc", "acc", "accuracy"]}
RUN_SCHEMA = "run string, cfg map<string,string>, params long, steps long, batch_size long, lr double, seed long, tok_fp string, best_val double, seconds double"
SHOWN = 5


def write_runs(steps: DataFrame, path: str, run: str = "run", tok_fp: str | None = None, lines: bool = True) -> None:
    """steps (run, step and numbers) as one JSON object a run, its steps in order, with its best val; for runs of bounded length."""
    numbers = [c for c in steps.columns if c != run]
    step = F.struct(*[F.col(quoted(c)).alias(c) for c in numbers])
    best = [F.min("val").alias("best_val")] if "val" in numbers else []
    rows = steps.groupBy(F.col(quoted(run)).cast("string").alias("run")).agg(F.array_sort(F.collect_list(step)).alias("history"), F.count(F.lit(1)).alias("steps"), *best)
    rows.withColumn("tok_fp", F.lit(tok_fp)).write.mode("append").option("ignoreNullFields", "true").json(path)


def _read(spark: SparkSession, path: str | list[str], whole_files: bool) -> DataFrame:
    reader = spark.read.schema(f"{RUN_SCHEMA}, history array<map<string,string>>").option("mode", "FAILFAST").option("multiLine", str(whole_files).lower())
    rows = reader.json(path)
    return rows.withColumn("run", F.coalesce("run", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")))


def read_runs(spark: SparkSession, path: str | list[str], whole_files: bool = False) -> DataFrame:
    """One row a run, without its steps. whole_files: each file is one object over many lines, named after its run."""
    return _read(spark, path, whole_files).drop("history")


def read_steps(spark: SparkSession, path: str | list[str], whole_files: bool = False) -> DataFrame:
    """(run, seed, step, train, val, sym_acc): one row a step of all runs."""
    rows = _read(spark, path, whole_files).select("run", "seed", F.explode("history").alias("h"))

    def number(name: str) -> Column:
        found = F.coalesce(*[F.try_element_at("h", F.lit(n)) for n in NAMES[name]])
        return found.try_cast("double")

    return rows.select("run", "seed", number("step").cast("long").alias("step"), *[number(c).alias(c) for c in ("train", "val", "sym_acc")])


def best_so_far(steps: DataFrame, value: str = "val", run: str = "run", step: str = "step", out: str = "best") -> DataFrame:
    """steps with the least value up to each step of its run."""
    upto = W.partitionBy(run).orderBy(F.col(quoted(step)).asc_nulls_first()).rangeBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumn(out, F.min(F.col(quoted(value))).over(upto))


def spread_of_best(steps: DataFrame, group: Column, cases: Column, value: str = "val", run: str = "run") -> DataFrame:
    """Mean and half the range, over the runs of each group, of a run's best value, with an interval for that many cases."""
    best = steps.groupBy(group.alias("group"), F.col(quoted(run)).alias("run")).agg(F.min(F.col(quoted(value))).alias("k"), F.lit(1.0).alias("n"), F.max(cases).alias("cases"))
    out = spread(best, "run", "group", "k", "n")
    return out.select("group", "n_runs", "mean_rate", "half_range")


def require_made_with(spark: SparkSession, path: str | list[str], fingerprint: str, whole_files: bool = False) -> int:
    """The number of stored runs, all of which were made with this fingerprint; raises ValueError if any was not, or none is there."""
    runs = read_runs(spark, path, whole_files).select("run", "tok_fp")
    other = ~F.coalesce(F.col("tok_fp") == fingerprint, F.lit(False))
    counts = runs.agg(F.count(F.lit(1)).alias("n"), F.count_if(other).alias("stale")).first()
    if not counts.n:
        raise ValueError(f"no runs in {path}")
    if counts.stale:
        few = [f"{r.run} ({r.tok_fp or 'none'})" for r in runs.where(other).orderBy("run").limit(SHOWN).collect()]
        raise ValueError(f"{counts.stale} of {counts.n} runs were made with others than {fingerprint}: {', '.join(few)}; make them anew")
    return counts.n
