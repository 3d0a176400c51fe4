"""The command grammar as structs: encode, parse, check shape and range. No Python runs on rows.

A frame is struct(action, targets array(struct(kind, n, s)), level, interval_ms, count). An absent slot is null, and a count
of 0 (for ever) is not an absent one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions.columns import free_name, staged

# Boards and bounds.
PINS_S3 = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 21, 38, 39, 40, 41, 42, 48]
PINS_WROOM = [2, 4, 5, 12, 13, 14, 15, 18, 19, 22, 23, 25, 26, 27, 32, 33]
INTERVAL_MIN, INTERVAL_MAX = 50, 10000
MAX_SEQ_PINS = 6
DEVICE_PINS, DEVICE_NAMES = 16, 4
MAX_DIGITS, NAME_CHARS = 6, 48
# End of fixed values.

TARGET = r"<all>|<pin>(?: [0-9]){1,6}|<name> [^<>]{1,48} <nend>"
COMMAND = (
    r"^<(set|read|blink|seq|stop|alias)>((?: (?:" + TARGET + r"))*)(?: <(high|low|toggle)>)?"
    r"(?: <int>((?: [0-9]){1,6}))?(?: <cnt>((?: [0-9]){1,6}))? <end>$"
)
TARGET_TYPE = "struct<kind:string,n:int,s:string>"


def _none_if_empty(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def _number(digits: Column) -> Column:
    return _none_if_empty(F.replace(digits, F.lit(" "), F.lit(""))).cast("int")


def with_frame(df: DataFrame, symbols: str, out: str = "frame") -> DataFrame:
    """df with the frame of a column of blank-joined symbols, null where they are malformed or break a shape rule.

    In steps, so that each regular expression and each array is computed once a row and not wherever it is used.
    """
    p, t, f = (free_name(c, df) for c in ("parts", "target_list", "parsed"))
    raw = F.col(symbols)
    part = lambda i: F.regexp_extract(raw, COMMAND, i)
    parts = F.when(raw.rlike(COMMAND), F.struct(*[part(i).alias(f"p{i}") for i in range(1, 6)]))
    targets = F.transform(
        F.regexp_extract_all(F.col(p)["p2"], F.lit(f"({TARGET})"), F.lit(1)),
        lambda x: F.struct(
            F.regexp_extract(x, "^<(all|pin|name)>", 1).alias("kind"),
            F.when(x.startswith("<pin>"), _number(F.substring(x, 7, 99))).alias("n"),
            F.when(x.startswith("<name>"), F.regexp_extract(x, "^<name> (.*) <nend>$", 1)).alias("s"),
        ),
    )
    frame = F.struct(
        F.col(p)["p1"].alias("action"), F.col(t).alias("targets"), _none_if_empty(F.col(p)["p3"]).alias("level"),
        _number(F.col(p)["p4"]).alias("interval_ms"), _number(F.col(p)["p5"]).alias("count"),
    )
    unknown = F.struct(
        F.lit("unknown").alias("action"), F.array().cast(f"array<{TARGET_TYPE}>").alias("targets"), F.lit(None).cast("string").alias("level"),
        F.lit(None).cast("int").alias("interval_ms"), F.lit(None).cast("int").alias("count"),
    )
    blank_name = F.exists(F.col(f)["targets"], lambda x: x["s"].isNotNull() & (F.trim(x["s"]) == ""))
    rows = staged(df.withColumn(p, parts)).withColumn(t, targets)
    rows = rows.withColumn(f, F.when(raw == "<unknown> <end>", unknown).when(F.col(p).isNotNull(), frame))
    shaped = F.when(F.col(f).isNotNull() & ~blank_name & well_shaped(F.col(f)), F.col(f))
    return staged(rows.withColumn(out, shaped).drop(p, t, f))


# What may follow what. 1: targets, 2: a pin's digits, 3: a name, 4: its end, 5: after the level, 6 and 8: digits of interval and
# count, 7 and 9: after them, 10: the end, 11: after <unknown>.
_NEXT = {
    0: {"<set>": 1, "<read>": 1, "<blink>": 1, "<seq>": 1, "<stop>": 1, "<alias>": 1, "<unknown>": 11},
    1: {"<all>": 1, "<pin>": 2, "<name>": 3, "<high>": 5, "<low>": 5, "<toggle>": 5, "<int>": 6, "<cnt>": 8, "<end>": 10},
    4: {"<nend>": 1}, 5: {"<int>": 6, "<cnt>": 8, "<end>": 10}, 7: {"<cnt>": 8, "<end>": 10}, 9: {"<end>": 10}, 11: {"<end>": 10},
}
_BEHIND, _WRONG = {2: 1, 6: 7, 8: 9}, 99
_OWN = ["<set>", "<read>", "<blink>", "<seq>", "<stop>", "<unknown>", "<alias>", "<pin>", "<all>", "<name>", "<nend>", "<high>", "<low>", "<toggle>", "<int>", "<cnt>", "<end>"]


def frame_of(symbols: Column, strict_device: bool = False) -> Column:
    """The frame of an array of symbols, null where they are malformed or break a shape rule; a state machine as a fold.

    Unlike with_frame(), which reads a line, it takes every name the grammar knows: with < and >, and with blanks at its
    ends, as long as it is no symbol, is not blank and has NAME_CHARS characters at most. An element of several digits counts
    as so many; digits beyond ASCII are none. A null array, an empty one and a null element are malformed.
    """
    from loomery.functions.text import SPACES

    none = lambda t: F.lit(None).cast(t)
    moves = F.expr("map(" + ", ".join(f"'{st}{s}', {to}" for st, own in _NEXT.items() for s, to in own.items()) + ")")
    target = lambda kind, n=None, s=None: F.array(F.struct(F.lit(kind).alias("kind"), (none("int") if n is None else n).alias("n"), (none("string") if s is None else s).alias("s")))
    start = F.struct(
        F.lit(0).alias("st"), none("string").alias("action"), F.array().cast(f"array<{TARGET_TYPE}>").alias("targets"), none("string").alias("level"),
        none("int").alias("interval_ms"), none("int").alias("count"), F.lit("").alias("run"),
    )

    def step(acc, s):
        st, run = acc["st"], acc["run"]
        digit = F.coalesce(s.rlike("^[0-9]+$"), F.lit(False))
        counting = st.isin(2, 6, 8)
        closes = counting & ~digit & (run != "")
        number = run.cast("int")
        at = F.when(closes & (st == 2), 1).when(closes & (st == 6), 7).when(closes & (st == 8), 9).otherwise(st)
        longer = F.concat(run, s)
        to = (
            F.when(s.isNull() | (counting & ~digit & (run == "")), _WRONG)
            .when(counting & digit, F.when(F.length(longer) <= MAX_DIGITS, st).otherwise(_WRONG))
            .when(st == 3, F.when(F.array_contains(F.expr("array(" + ", ".join(f"'{x}'" for x in _OWN) + ")"), s), _WRONG).otherwise(4))
            .otherwise(F.coalesce(F.try_element_at(moves, F.concat(at.cast("string"), s)), F.lit(_WRONG)))
        )
        nothing = F.array().cast(f"array<{TARGET_TYPE}>")
        closed = F.when(closes & (st == 2), target("pin", number)).otherwise(nothing)
        named = F.when((st == 4) & (s == "<nend>"), target("name", s=run)).when((at == 1) & (s == "<all>"), target("all")).otherwise(nothing)
        return F.struct(
            to.alias("st"), F.when(st == 0, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(acc["action"]).alias("action"), F.concat(acc["targets"], closed, named).alias("targets"),
            F.when((at == 1) & (to == 5), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(acc["level"]).alias("level"),
            F.when(closes & (st == 6), number).otherwise(acc["interval_ms"]).alias("interval_ms"), F.when(closes & (st == 8), number).otherwise(acc["count"]).alias("count"),
            F.when(counting & digit, longer).when(st == 3, s).otherwise("").alias("run"),
        )

    parsed = F.aggregate(symbols, start, step)
    odd = lambda x: F.exists(x["targets"], lambda t: (t["kind"] == "name") & (~F.coalesce(t["s"].rlike(f"^{SPACES}*+."), F.lit(False)) | (F.length(t["s"]) > NAME_CHARS)))
    frame = lambda x: F.struct(*[x[c].alias(c) for c in ("action", "targets", "level", "interval_ms", "count")])
    # a lambda's variable holds what the fold gives, so that it is folded once
    return F.get(F.transform(F.array(parsed), lambda x: F.when((x["st"] == 10) & ~odd(x) & well_shaped(frame(x), strict_device), frame(x))), F.lit(0))


def well_shaped(f: Column, strict_device: bool = False) -> Column:
    """The slots that each action takes. strict_device adds the device's own limits."""
    n = F.size(f["targets"])
    every = F.exists(f["targets"], lambda t: t["kind"] == "all")
    names = F.size(F.filter(f["targets"], lambda t: t["kind"] == "name"))
    level, rate, rounds = (f[c].isNotNull() for c in ("level", "interval_ms", "count"))
    alone = ~(every & (n > 1))
    paced = ~(rate & ~rounds)
    action = f["action"]
    ok = (
        F.when(action == "set", (n >= 1) & alone & level & ~rate & ~rounds)
        .when(action == "read", (n >= 1) & ~every & ~level)
        .when(action == "blink", (n >= 1) & alone & paced & (~level if strict_device else F.lit(True)))
        .when(action == "seq", ((n >= 2) | (names > 0)) & ~every & paced & (~level if strict_device else F.lit(True)))
        .when(action == "stop", ~every & ~level & ~rate)
        .when(action == "alias", (names == 1) & (n >= 2) & ~every & ~level & ~rate & ~rounds)
        .when(action == "unknown", (n == 0) & ~level & ~rate & ~rounds)
        .otherwise(F.lit(False))
    )
    return ok & (n - names <= DEVICE_PINS) & (names <= DEVICE_NAMES) if strict_device else ok


def range_verdict(f: Column, pins: list[int] = PINS_S3) -> Column:
    """Can the board do it? The order of the cases is part of the meaning."""
    allowed = F.array(*map(F.lit, pins))
    return (
        F.when(f["action"] == "unknown", "execute")
        .when(F.exists(f["targets"], lambda t: (t["kind"] == "pin") & ~F.array_contains(allowed, t["n"])), "bad_pin")
        .when((f["action"] == "seq") & (F.size(f["targets"]) > MAX_SEQ_PINS), "too_many_pins")
        .when(f["interval_ms"].isNotNull() & ~f["interval_ms"].between(INTERVAL_MIN, INTERVAL_MAX), "bad_interval")
        .otherwise("execute")
    )


def range_message(f: Column, pins: list[int] = PINS_S3) -> Column:
    allowed = F.array(*map(F.lit, pins))
    bad = F.get(F.filter(f["targets"], lambda t: (t["kind"] == "pin") & ~F.array_contains(allowed, t["n"])), F.lit(0))["n"]
    verdict = range_verdict(f, pins)
    return (
        F.when(verdict == "bad_pin", F.format_string("pin %d is not on this board", bad))
        .when(verdict == "too_many_pins", F.format_string("a chase has %d pins at most, not %d", F.lit(MAX_SEQ_PINS), F.size(f["targets"])))
        .when(verdict == "bad_interval", F.format_string("%d ms is not within %d to %d ms", f["interval_ms"], F.lit(INTERVAL_MIN), F.lit(INTERVAL_MAX)))
        .otherwise("")
    )


def runs(f: Column, pins: list[int] = PINS_S3) -> Column:
    return f.isNotNull() & (f["action"] != "unknown") & (range_verdict(f, pins) == "execute")


def _digits(n: Column) -> Column:
    return F.array_compact(F.split(n.cast("string"), ""))


def to_symbols(f: Column) -> Column:
    """The symbols of a frame; numbers are split into digits, a name is one symbol."""
    one = lambda s: F.array(F.lit(s))
    targets = F.flatten(
        F.transform(
            f["targets"],
            lambda t: F.when(t["kind"] == "all", one("<all>"))
            .when(t["kind"] == "pin", F.concat(one("<pin>"), _digits(t["n"])))
            .otherwise(F.array(F.lit("<name>"), t["s"], F.lit("<nend>"))),
        )
    )
    none = F.array().cast("array<string>")
    slot = lambda mark, n: F.when(n.isNotNull(), F.concat(one(mark), _digits(n))).otherwise(none)
    return F.concat(
        F.array(F.concat(F.lit("<"), f["action"], F.lit(">"))), targets,
        F.when(f["level"].isNotNull(), F.array(F.concat(F.lit("<"), f["level"], F.lit(">")))).otherwise(none),
        slot("<int>", f["interval_ms"]), slot("<cnt>", f["count"]), one("<end>"),
    )


def describe(f: Column) -> Column:
    """A frame in one line: action, all, pins, quoted names, level, interval and rounds; null for a null frame."""
    every = F.exists(f["targets"], lambda t: t["kind"] == "all")
    names = F.filter(f["targets"], lambda t: t["kind"] == "name")
    return F.when(
        f.isNotNull(),
        F.concat_ws(
            " ", f["action"], F.when(every, "all"), F.transform(pins_of(f), lambda n: F.concat(F.lit("pin"), n.cast("string"))),
            F.transform(names, lambda t: F.concat(F.lit('"'), t["s"], F.lit('"'))), f["level"], F.concat(f["interval_ms"].cast("string"), F.lit("ms")), F.concat(F.lit("x"), f["count"].cast("string")),
        ),
    )


def device_verdict(f: Column, pins: list[int] = PINS_S3) -> Column:
    """range_verdict() as the device has it: to refuse is a verdict of its own, and a chase is as long as its pins."""
    allowed = F.array(*map(F.lit, pins))
    return (
        F.when(f["action"] == "unknown", "unknown")
        .when(F.exists(pins_of(f), lambda n: ~F.array_contains(allowed, n)), "bad_pin")
        .when((f["action"] == "seq") & (F.size(pins_of(f)) > MAX_SEQ_PINS), "too_many_pins")
        .when(f["interval_ms"].isNotNull() & ~f["interval_ms"].between(INTERVAL_MIN, INTERVAL_MAX), "bad_interval")
        .otherwise("execute")
    )


def symbols_of(ids: Column, symbols: dict[int, str], texts: Column) -> Column:
    """The symbols of generated ids; what stands between <name> and <nend> is one element, the trimmed texts of its ids.

    texts is a map from id to text for ids within a name. A name that is not closed stays so; an unknown id is an empty symbol.
    """
    table = F.create_map(*[F.lit(x) for pair in symbols.items() for x in pair])
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("out"), none.alias("name"))

    def step(acc, i):
        s = F.coalesce(F.try_element_at(table, i), F.lit(""))
        longer = F.concat(acc["name"], F.coalesce(F.try_element_at(texts, i), s))
        return (
            F.when(acc["name"].isNotNull() & (s != "<nend>"), F.struct(acc["out"].alias("out"), longer.alias("name")))
            .when(acc["name"].isNotNull(), F.struct(F.concat(acc["out"], F.array(F.trim(acc["name"]), s)).alias("out"), none.alias("name")))
            .when(s == "<name>", F.struct(F.concat(acc["out"], F.array(s)).alias("out"), F.lit("").alias("name")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(s)).alias("out"), none.alias("name")))
        )

    end = lambda acc: F.when(acc["name"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.trim(acc["name"]))))
    return F.aggregate(ids, start, step, end)


def pins_of(f: Column) -> Column:
    return F.transform(F.filter(f["targets"], lambda t: t["kind"] == "pin"), lambda t: t["n"])


def names_of(f: Column) -> Column:
    from loomery.functions.text import name_norm

    return F.transform(F.filter(f["targets"], lambda t: t["kind"] == "name"), lambda t: name_norm(t["s"]))


def frame_key(f: Column) -> Column:
    """What two frames must share to be the same; the order of targets counts, the spelling of names does not."""
    from loomery.functions.text import name_norm

    targets = F.transform(f["targets"], lambda t: F.struct(t["kind"].alias("kind"), t["n"].alias("n"), name_norm(t["s"]).alias("s")))
    return F.when(f.isNotNull(), F.struct(f["action"].alias("action"), targets.alias("targets"), f["level"].alias("level"), f["interval_ms"].alias("interval_ms"), f["count"].alias("count")))
