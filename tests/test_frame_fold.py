"""The fold over arrays of symbols against a parser written out, and against the parser of lines."""

import random

from pyspark.sql import functions as F

from loomery.functions import grammar as G

ACTIONS = ["set", "read", "blink", "seq", "stop", "alias"]
NAMES = ["lamp", " lamp ", "a < b", "<pin", "pin>", "<<>>", "", "  ", " ", "<pin>", "<end>", "x" * 48, "x" * 49, "12", "é ", "\n", "_"]


def shaped(action, targets, level, ms, count):
    n, every = len(targets), any(t[0] == "all" for t in targets)
    names = sum(t[0] == "name" for t in targets)
    alone, paced = not (every and n > 1), not (ms is not None and count is None)
    return {
        "set": n >= 1 and alone and level is not None and ms is None and count is None, "read": n >= 1 and not every and level is None,
        "blink": n >= 1 and alone and paced, "seq": (n >= 2 or names > 0) and not every and paced, "stop": not every and level is None and ms is None,
        "alias": names == 1 and n >= 2 and not every and level is None and ms is None and count is None,
    }[action]


def parse(symbols):
    """A frame as a tuple, or None."""
    if not symbols or any(s is None for s in symbols):
        return None
    if symbols[0] == "<unknown>":
        return ("unknown", [], None, None, None) if symbols[1:] == ["<end>"] else None
    if symbols[0][1:-1] not in ACTIONS or symbols[0] != f"<{symbols[0][1:-1]}>":
        return None
    rest = symbols[1:]

    def number():
        out = ""
        while rest and rest[0].isascii() and rest[0].isdigit():
            out += rest.pop(0)
        return int(out) if 0 < len(out) <= 6 else None

    targets, level, slots = [], None, [None, None]
    while rest and rest[0] in ("<all>", "<pin>", "<name>"):
        kind = rest.pop(0)
        if kind == "<all>":
            targets.append(("all", None, None))
        elif kind == "<pin>":
            n = number()
            if n is None:
                return None
            targets.append(("pin", n, None))
        else:
            if len(rest) < 2 or rest[0] in G._OWN or rest[1] != "<nend>" or not rest[0].strip() or len(rest[0]) > 48:
                return None
            targets.append(("name", None, rest.pop(0)))
            rest.pop(0)
    if rest and rest[0] in ("<high>", "<low>", "<toggle>"):
        level = rest.pop(0)[1:-1]
    for i, mark in enumerate(("<int>", "<cnt>")):
        if rest and rest[0] == mark:
            rest.pop(0)
            slots[i] = number()
            if slots[i] is None:
                return None
    action = symbols[0][1:-1]
    return (action, targets, level, *slots) if rest == ["<end>"] and shaped(action, targets, level, *slots) else None


def lines(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = [f"<{rng.choice([*ACTIONS, 'unknown'])}>"]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            s += rng.choice([["<all>"], ["<pin>", *str(rng.randrange(60))], ["<pin>", *str(rng.randrange(60))], ["<name>", rng.choice(NAMES), "<nend>"], ["<pin>", "1234567"], ["<pin>"], ["<pin>", "12", "3"]])
        s += rng.choice([[], [], ["<high>"], ["<low>"], ["<toggle>"]]) + rng.choice([[], [], ["<int>", "5", "0", "0"], ["<int>"]]) + rng.choice([[], [], ["<cnt>", "3"], ["<cnt>", "0"]]) + ["<end>"]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            i = rng.randrange(max(1, len(s)))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + [rng.choice(["<end>", "<high>", "7", None, "word", "²", "٣"])] + s[i:], s[:i]])
        out.append(s)
    return [*out, [], None]


def as_tuple(f):
    return None if f is None else (f.action, [tuple(t) for t in f.targets], f.level, f.interval_ms, f["count"])


def test_the_fold_equals_the_parser(spark):
    many = lines(4000, 1)
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(many)], "i int, s array<string>").repartition(4)
    got = {r.i: as_tuple(r.f) for r in frame.select("i", G.frame_of(F.col("s")).alias("f")).collect()}
    want = {i: parse(list(s)) if s is not None else None for i, s in enumerate(many)}
    assert [(many[i], got[i], want[i]) for i in want if got[i] != want[i]] == []
    assert sum(x is not None for x in want.values()) > 150 and any(t[0] == "name" and "<" in t[2] for x in want.values() if x for t in x[1])


def test_round_trip_with_any_name(spark):
    frame = spark.createDataFrame([(n,) for n in NAMES], "n string")
    symbols = F.array(F.lit("<alias>"), F.lit("<pin>"), F.lit("4"), F.lit("<name>"), F.col("n"), F.lit("<nend>"), F.lit("<end>"))
    rows = frame.select("n", symbols.alias("s")).select("n", "s", G.frame_of(F.col("s")).alias("f")).select("n", F.col("f").isNotNull().alias("ok"), (G.to_symbols(F.col("f")) == F.col("s")).alias("same"))
    for r in rows.collect():
        assert r.ok == (bool(r.n.strip()) and len(r.n) <= 48 and r.n not in G._OWN), r
        assert r.same in (True, None) and bool(r.same) == r.ok
