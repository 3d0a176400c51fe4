"""The driver's tables and the corpus files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.sources.formats import files_of, register

CORPUS_SCHEMA = "text string, symbols array<string>, action string, source string, split string"
HELD_OUT_SCHEMA = (
    "text string, symbols array<string>, action string, source string, stratum string, in_train boolean, "
    "v2_class string, v2_deferred boolean, locked boolean"
)
META_SCHEMA = "vocab int, seq_len int, pad int, go int, reserved map<string,int>, n_train long, n_val long"
MIN_WORDS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, schema: str, *folders: str, split: str) -> DataFrame:
    """One JSON object a line, from the first folder that has the split; if none has, FileNotFoundError at once."""
    files_of(list(folders), split)
    register(spark)
    return spark.read.format("split_lines").schema(schema).option("folders", json.dumps(folders)).option("split", split).load()


def write_corpus(df: DataFrame, path: str, by: str = "split", fmt: str = "json") -> None:
    """A folder for each split or stratum; JSON lines or Parquet."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def write_report(lines: DataFrame, path: str) -> None:
    """A text column as a file for people to read."""
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_external(frames: list[DataFrame], intent: str = "label_text", text: str = "text", order: str = "id") -> DataFrame:
    """(intent, text, ord) of the splits of an outside dataset, in the order of the list and of a column within it."""
    out = None
    for i, df in enumerate(frames):
        part = df.select(F.col(intent).alias("intent"), F.col(text).alias("text"), F.struct(F.lit(i).alias("part"), F.col(order).alias("at")).alias("ord"))
        out = part if out is None else out.unionByName(part)
    return out


def by_intent(df: DataFrame, kept: list[str] | None = None, family: str | None = None, intent: str = "intent") -> DataFrame:
    """The rows of some intents, or those outside a family of intents, by its prefix; rows without an intent are in neither."""
    i = F.col(intent)
    return df.where((i.isin(kept) if kept is not None else F.lit(True)) & (~i.startswith(family) if family else F.lit(True)) & i.isNotNull())


def first_rows(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows in file order; the limit is the operator's purpose."""
    return df.orderBy(order).limit(limit)


def write_matrix(df: DataFrame, path: str, width: int, tokens: str = "tokens", mask: str = "mask") -> None:
    """Packed sequences of one width as Parquet; a row of another width fails the write."""
    checked = lambda c: F.when(F.size(c) == width, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not {width} wide")))
    df.withColumns({tokens: checked(tokens), mask: checked(mask)}).write.mode("overwrite").parquet(path)


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """The settings of a matrix as one line of JSON."""
    spark.createDataFrame([meta], META_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    row = spark.read.schema(META_SCHEMA).json(path).first()
    if row is None or row.vocab is None or row.seq_len is None:
        raise ValueError(f"no settings in {path}")
    return row.asDict()


def read_words(spark: SparkSession, path: str, least: int = MIN_WORDS) -> DataFrame:
    """(word, weight): lines of word and optional tab and count; blank lines and # comments are passed over."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    parts = F.split("v", "\t", 2)
    words = lines.select(F.trim(parts[0]).alias("word"), F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1))).cast("int")).alias("weight"))
    if words.limit(least).count() < least:
        raise ValueError(f"a word list needs {least} words")
    return words


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, unless it is empty: a check that compared nothing must not pass."""
    if df.isEmpty():
        raise ValueError(f"nothing to compare: {what} has no rows")
    return df


def stream_lines(spark: SparkSession, folder: str, longest: int = 255) -> DataFrame:
    """Lines appended to a folder as a stream: carriage returns dropped, cut at the longest that a device takes."""
    lines = spark.readStream.text(folder).select(F.substring(F.regexp_replace("value", "\r", ""), 1, longest).alias("line"))
    return lines.where(F.trim("line") != "")

