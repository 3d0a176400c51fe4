"""Names of pins: all-or-nothing resolution of commands against a table of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.columns import free_name, quoted, staged
from loomery.functions.grammar import DEVICE_PINS
from loomery.functions.text import alias_norm
from loomery.operators.curate import FEW_GROUPS, looked_up
from loomery.sources.scratch import fixed


MAX_ENTRIES = 10_000  # of one map of aliases


def resolve(commands: DataFrame, aliases: DataFrame, *keys: str, fold=alias_norm, most: int = MAX_ENTRIES) -> DataFrame:
    """commands (action, pins, names and any others) with verdict and resolved pins, row by row.

    Each name, in order, adds its pins. The first that is unknown, or that brings more than a device holds, decides the
    verdict and empties the pins; a chase of fewer than two pins is refused. Defining a name resolves nothing. keys are
    columns that both tables share (such as the device), for tables with a set of aliases each.

    fold is how names are made alike: the device's way, or text.name_fold for names beyond ASCII. The aliases of a device
    become one map, if none has more than `most`, so commands are neither exploded nor regrouped; beyond that, names are
    joined one by one and put together again. Rows that repeat stay as many as they are.

    Defined results: aliases that fold alike are one, with the least pins; aliases with a null name or null pins are none; a
    null name in a command is unknown; null pins or names are empty arrays; null keys match null keys. Extra columns stay, but
    for verdict and resolved.
    """
    folded = aliases.select(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(keys)], fold(F.col("name")).alias("norm"), F.col("pins").cast("array<int>").alias("pins"))
    groups = [f"k{i}" for i in range(len(keys))]
    single = folded.where("norm is not null and pins is not null").groupBy(*groups, "norm").agg(F.min("pins").alias("pins"))
    widest = single.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (widest or 0) > most:
        joined, names = _joined(commands, single, keys, fold)
        return _decided(commands, joined, names)
    table, mine = free_name("aliases", commands), [free_name(f"alias_key_{i}", commands) for i in range(len(keys))]
    maps = single.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("norm", "pins"))).alias(table))
    maps = maps.select(*[F.col(g).alias(m) for g, m in zip(groups, mine)], table)
    if keys:
        same = F.lit(True)
        for k, m in zip(keys, mine):
            same = same & commands[quoted(k)].eqNullSafe(maps[m])
        joined = commands.join(maps, same, "left")
    else:
        joined = commands.crossJoin(F.broadcast(maps))  # one row
    names = free_name("looked_up", joined)
    looked = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.try_element_at(F.col(table), fold(n)))
    return _decided(commands, staged(joined).withColumn(names, looked), names)


def _joined(commands: DataFrame, single: DataFrame, keys: tuple[str, ...], fold) -> tuple[DataFrame, str]:
    """commands with what each name stands for, by a join of the names; and that column."""
    row, at, name, names = (free_name(c, commands) for c in ("row", "at", "one_name", "looked_up"))
    rows = fixed(commands.withColumn(row, F.monotonically_increasing_id()))
    mine = [free_name(f"alias_key_{i}", commands) for i in range(len(keys))]
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  (null keys match)
    asked = rows.select(row, *[text(quoted(k)).alias(m) for k, m in zip(keys, mine)], F.posexplode("names").alias(at, name)).withColumn(name, fold(F.col(name)))
    told = single.select(*[text(f"k{i}").alias(m) for i, m in enumerate(mine)], F.col("norm").alias(name), "pins")
    found = looked_up(asked, told, [*mine, name], FEW_GROUPS, "left")
    lists = found.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, "pins"))), lambda x: x["pins"]).alias(names))
    joined = rows.join(lists, row, "left")
    return joined.withColumn(names, F.coalesce(names, F.array().cast("array<array<int>>"))), names


def _decided(commands: DataFrame, joined: DataFrame, looked: str) -> DataFrame:
    """The verdicts of commands whose names are looked up."""
    none = F.array().cast("array<int>")
    names, step = (free_name(c, joined) for c in ("known_names", "step"))
    joined = joined.withColumn(names, F.when(F.col("action") == "alias", F.array().cast("array<array<int>>")).otherwise(F.col(looked)))
    # what the names before the first failure, and that one, add up to
    total = F.aggregate(
        names,
        F.struct(F.coalesce(F.col("pins").cast("array<int>"), none).alias("p"), F.lit("execute").alias("v")),
        lambda acc, x: F.when(acc["v"] != "execute", acc)
        .when(x.isNull(), F.struct(none.alias("p"), F.lit("unknown_name").alias("v")))
        .when(F.size(acc["p"]) + F.size(x) > DEVICE_PINS, F.struct(none.alias("p"), F.lit("too_many_pins").alias("v")))
        .otherwise(F.struct(F.concat(acc["p"], x).alias("p"), F.lit("execute").alias("v"))),
    )
    out = staged(staged(joined).withColumn(step, total))
    few = (F.col("action") == "seq") & (F.col(step)["v"] == "execute") & (F.size(names) > 0) & (F.size(F.col(step)["p"]) < 2)
    verdict = F.when(few, "name_too_few_pins").otherwise(F.col(step)["v"])
    kept = [F.col(quoted(c)) for c in commands.columns if c not in ("verdict", "resolved")]
    return out.select(*kept, verdict.alias("verdict"), F.when(few, none).otherwise(F.col(step)["p"]).alias("resolved"))
