"""Template banks: weighted templates with slots, filled by hash; each is a Column and, from the same definition, SQL.

A slot is a list of options, a dict of options and weights, a pair of bounds for a number, or Letters. Slots are filled in the
order they are given in, so an option may hold the slots behind it. Every choice is drawn from a SHA-1 of the row's key and the
slot's name: a row gets the same text in any partitioning, and other engines can say what it must be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions.text import draw, listed, pick

SCALE = 1_000_000
DIGITS, LETTERS = "0123456789", "qwxzjkvyug"


@dataclass
class Letters:
    """A word of hash letters, of low to high characters."""

    low: int
    high: int


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_draw(key: str, below: int) -> str:
    return f"(cast('0x' || substr(sha1({key}), 1, 8) as bigint) % {below})"


def edges(weights: dict[str, float]) -> list[int]:
    """Where each option but the last ends, in SCALE parts."""
    total, upto, out = sum(weights.values()), 0.0, []
    for w in list(weights.values())[:-1]:
        upto += w
        out.append(int(SCALE * upto / total))
    return out


def choice(options, key: Column) -> Column:
    if isinstance(options, Letters):
        size = (draw(F.concat(key, F.lit("#")), options.high - options.low + 1) + options.low).cast("int")
        return F.substring(F.translate(F.sha1(key), DIGITS, LETTERS), F.lit(1), size)
    if isinstance(options, tuple):
        return (draw(key, options[1] - options[0] + 1) + options[0]).cast("string")
    if isinstance(options, dict):
        passed = F.filter(listed(edges(options)), lambda e: e <= draw(key, SCALE))
        return F.element_at(listed(list(options)), F.size(passed) + 1)
    return pick(options, key)


def sql_choice(options, key: str) -> str:
    if isinstance(options, Letters):
        size = f"({sql_draw(f'{key} || {literal("#")}', options.high - options.low + 1)} + {options.low})"
        return f"substr(translate(sha1({key}), '{DIGITS}', '{LETTERS}'), 1, {size})"
    if isinstance(options, tuple):
        return f"cast({sql_draw(key, options[1] - options[0] + 1)} + {options[0]} as varchar)"
    listed = "[" + ", ".join(map(literal, options)) + "]"
    if isinstance(options, dict):
        return f"{listed}[1 + len(list_filter({edges(options)}, lambda e: e <= {sql_draw(key, SCALE)}))]"
    return f"{listed}[1 + {sql_draw(key, len(options))}]"


class Bank:
    def __init__(self, templates, **slots):
        self.templates, self.slots = templates, slots

    def column(self, key: Column) -> Column:
        """The text that a row's key gives; the key is a string."""
        out = choice(self.templates, F.concat(key, F.lit("|")))
        for name, options in self.slots.items():
            slot, filled = F.lit("{" + name + "}"), choice(options, F.concat(key, F.lit("|" + name)))
            # as a lambda's variable the text so far stands here once, and what fills a slot is only drawn where the slot is
            out = F.get(F.transform(F.array(out), lambda x: F.when(F.contains(x, slot), F.replace(x, slot, filled)).otherwise(x)), F.lit(0))  # noqa: B023
        return out

    def sql(self, key: str) -> str:
        """The same as a DuckDB expression; key is the SQL of the row's key."""
        out = sql_choice(self.templates, f"{key} || '|'")
        for name, options in self.slots.items():
            out = f"replace({out}, '{{{name}}}', {sql_choice(options, f'{key} || {literal("|" + name)}')})"
        return out
