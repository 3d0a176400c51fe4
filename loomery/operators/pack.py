"""Token sequences for training: byte pairs, prompt and completion in fixed width, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.operators.bytepairs import byte_letters

PAD, GO = 0, 1
# The reserved symbols, in the order of their ids.
RESERVED = [
    "<pad>", "<go>", "<set>", "<read>", "<blink>", "<seq>", "<stop>", "<unknown>", "<alias>", "<pin>", "<all>", "<name>", "<nend>",
    "<high>", "<low>", "<toggle>", "<int>", "<cnt>", "<end>",
]
# End of fixed values.


def symbol_ids(symbols: Column) -> Column:
    """Ids of symbols, null where one is not reserved."""
    table = F.create_map(*[F.lit(x) for i, s in enumerate(RESERVED) for x in (s, i)])
    return F.transform(symbols, lambda s: F.try_element_at(table, s))


def completion_ids(symbols: Column, digit_ids: list[int], name_ids: Column) -> Column:
    """Ids of a label: reserved symbols, single digits, and name_ids in the place of the one name; null if anything else is there."""
    table = F.create_map(*[F.lit(x) for i, s in enumerate(RESERVED) for x in (s, i)], *[F.lit(x) for d, i in enumerate(digit_ids) for x in (str(d), i)])
    inside = F.transform(symbols, lambda s, i: F.when((i > 0) & (F.get(symbols, i - 1) == "<name>"), name_ids).otherwise(F.array(F.try_element_at(table, s))))
    flat = F.flatten(inside)
    return F.when(F.forall(flat, lambda x: x.isNotNull()), flat)


def byte_symbols(byte: Column) -> Column:
    """The character that stands for a byte in byte-pair files, as its code: itself where it prints, else those from 256 on in order."""
    table = F.create_map(*[F.lit(x) for c, b in byte_letters().items() for x in (b, ord(c))])
    return F.element_at(table, byte)


def pack(df: DataFrame, prompt: str, completion: str, width: int) -> DataFrame:
    """tokens and mask of a fixed width: prompt, mark, completion, padding; the mask is on the completion alone.

    Rows that do not fit are dropped, as the format demands; overlong() counts them.
    """
    full = F.concat(F.col(prompt), F.array(F.lit(GO)), F.col(completion))
    size, start = F.size(full), F.size(F.col(prompt)) + 1
    places = F.sequence(F.lit(0), F.lit(width - 1))
    return df.where(size <= width).withColumn("tokens", F.concat(full, F.array_repeat(F.lit(PAD), F.lit(width) - size))).withColumn(
        "mask", F.transform(places, lambda i: ((i >= start) & (i < size)).cast("int"))
    )


def in_parts(df: DataFrame, prompt: str, completion: str, width: int) -> DataFrame:
    """df with prompts that leave no room cut into as many as fit, in order of part; the completion is with each."""
    room = F.lit(width - 1) - F.size(F.col(completion))
    parts = F.greatest(F.lit(1), F.ceil(F.size(F.col(prompt)) / room).cast("int"))
    # as arrays: behind an explode of numbers the whole prompt would be repeated for each part
    pieces = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.slice(F.col(prompt), i * room + 1, room))
    others = [c for c in df.columns if c != prompt]
    return df.select(*others, F.posexplode(pieces).alias("part", prompt))


def overlong(df: DataFrame, prompt: str, completion: str, width: int) -> DataFrame:
    size = F.size(F.col(prompt)) + 1 + F.size(F.col(completion))
    return df.agg(F.count_if(size <= width).alias("kept"), F.count_if(size > width).alias("dropped"), F.max(size).alias("longest"))


def last_tokens(ids: Column, budget: int) -> Column:
    """The end of a sequence that is longer than its budget."""
    return F.when(F.size(ids) > budget, F.slice(ids, F.lit(-budget), F.lit(budget))).otherwise(ids)
