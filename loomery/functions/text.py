"""Text kernel: cleaning, keys, buckets and small generators, all Column to Column.

White space is ASCII here (Java's \\s) unless a function says otherwise; lower() is Unicode.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions.templates import openings

# Patterns and word lists that results depend on.
WAKE_WORDS = r"(?i)\b(olly|ollie|hey olly)\b"
LEAD_PREFIX = r"(?i)^(please |can you |could you |would you |i want you to |hey |ok |go ahead and |just |now )+"
LEAD_PREFIX_ALL = r"(?i)^(please |can you |could you |would you |i want you to |hey |ok |go ahead and |just |now |so )+"
VARY_TAIL = r"(?i)( please| now| for me| thanks| ok\?)+$"
COLLIDE_WORDS = (
    r"(?i)\b(pin|pins|gpio|gpios|led|leds|blink|blinking|flash|flashing|strobe|pulse|toggle|chase|sequence|relay|buzzer|siren|"
    r"solenoid|high|low|lamp|lamps|light|lights|socket|plug|fan|fans|stop|halt|cancel|freeze|abort|quit)\b"
)
VARY_PREFIX = ["", "please ", "can you ", "could you ", "hey ", "ok ", "i want you to ", "go ahead and ", "just ", "now ", "so "]
VARY_SUFFIX = ["", " please", " now", " for me", " thanks", " ok?"]
HOLD_OUT_SHARE = 4
DANGLING = [
    "the", "a", "an", "my", "that", "this", "to", "at", "of", "in", "for", "every", "and", "with", "from", "is", "are", "was", "turn",
    "set", "make", "blink", "flash", "strobe", "pulse", "read", "check", "chase", "cycle", "sweep", "scan", "name", "call", "label",
    "alias", "rename", "toggle", "flip", "switch", "power", "shut", "please", "can", "could", "would", "want", "go", "just", "state",
    "status", "level", "interval", "speed", "count", "pin", "gpio", "pins", "gpios", "across", "through", "up", "rate", "start",
    "get", "give", "put", "have", "let", "run", "step", "walk", "cancel", "halt", "leave", "keep", "i", "you", "me", "we", "it's",
]
# End of fixed values.

#: White space as Unicode has it, and the separators of ASCII.
SPACES = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Openings of commands, from our own templates.
OPENINGS = openings()


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean(s: Column) -> Column:
    """Without wake words, white space collapsed, blanks and commas off the ends."""
    return F.regexp_replace(collapse(F.regexp_replace(s, WAKE_WORDS, " ")), r"^[ ,]+|[ ,]+$", "")


def dedup_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"^\s+|\s+$", "")


def partition_key(s: Column) -> Column:
    """The text without one run of leading courtesies and one of trailing ones, to the letter of the definition."""
    s = F.regexp_replace(dedup_key(s), LEAD_PREFIX, "")
    s = F.regexp_replace(s, VARY_TAIL, "")
    return collapse(F.regexp_replace(s, r"^[ .,!?]+|[ .,!?]+$", ""))


def partition_key_stable(s: Column, rounds: int = 4) -> Column:
    """Like partition_key, but the same for a text and all its decorations: strips marks, heads and tails in turn."""
    s = collapse(dedup_key(s))
    for _ in range(rounds):
        s = F.regexp_replace(s, r"^[ .,!?]+|[ .,!?]+$", "")
        s = F.regexp_replace(s, LEAD_PREFIX_ALL, "")
        s = F.regexp_replace(s, r"(?i)( please| now| for me| thanks| ok)+$", "")
    return collapse(s)


def draw(s: Column, below: int) -> Column:
    """A number below a bound from a string, by the first 32 bits of its SHA-1."""
    return F.conv(F.substring(F.sha1(s), 1, 8), 16, 10).cast("bigint") % below


def bucket10(key: Column) -> Column:
    return draw(key, 10)


def is_held_out(text: Column) -> Column:
    return bucket10(partition_key(text)) < HOLD_OUT_SHARE


def is_locked(text: Column) -> Column:
    """The half of the held-out rows that is kept shut; the salt goes in front before the key is taken."""
    return bucket10(partition_key(F.concat(F.lit("locked:"), text))) < HOLD_OUT_SHARE


def collides(s: Column) -> Column:
    """Might the text be a command of ours? By word, or by opening."""
    body = F.trim(F.regexp_replace(F.lower(s), LEAD_PREFIX, ""))
    opens = F.exists(F.array(*[F.lit(o + " ") for o in OPENINGS]), lambda o: F.startswith(body, o))
    return s.rlike(COLLIDE_WORDS) | opens


def name_norm(s: Column) -> Column:
    """Underscores and hyphens are blanks, white space collapsed, lower case (ASCII-safe; see name_fold)."""
    return collapse(F.translate(F.lower(s), "_-", "  "))


@cache
def folding() -> tuple[str, str, list[tuple[str, str]]]:
    """What full case folding does to single characters: those that become one other, these, and those that become several."""
    folded = {c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c}
    one = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), [(c, f) for c, f in folded.items() if len(f) > 1]


def name_fold(s: Column) -> Column:
    """name_norm by full case folding and Unicode white space, for names beyond ASCII: characters by a table, no Python on rows."""
    before, after, longer = folding()
    pairs = F.expr("array(" + ", ".join(f"struct('{c}' as c, '{f}' as f)" for c, f in longer) + ")")
    spread = F.when(s.rlike("[" + "".join(c for c, _ in longer) + "]"), F.aggregate(pairs, s, lambda acc, x: F.replace(acc, x["c"], x["f"]))).otherwise(s)
    wide = F.translate(spread, before, after)
    folded = F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(wide)
    return F.regexp_replace(F.regexp_replace(F.translate(folded, "_-", "  "), f"{SPACES}+", " "), "^ | $", "")


def alias_norm(s: Column) -> Column:
    """The device's folding: ASCII lower case, and blanks, tabs, underscores and hyphens collapsed."""
    low = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[ \t_\-]+", " "))


def digit_runs(s: Column, longest: int = 6) -> Column:
    """The numbers of at most so many digits."""
    runs = F.regexp_extract_all(s, F.lit(r"[0-9]+"), F.lit(0))
    return F.transform(F.filter(runs, lambda r: F.length(r) <= longest), lambda r: r.cast("int"))


def listed(options: list) -> Column:
    """An array of constants, strings or whole numbers, as one expression."""
    one = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    return F.expr("array(" + ", ".join(map(one, options)) + ")")


def pick(options: list[str], key: Column) -> Column:
    return F.element_at(listed(options), (draw(key, len(options)) + 1).cast("int"))


def vary(s: Column, key: Column) -> Column:
    """The text dressed anew: first letter small, end marks off, a courtesy before and behind, then case and end mark."""
    body = F.regexp_replace(F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)), r"[?.!]+$", "")
    dressed = collapse(F.concat(pick(VARY_PREFIX, F.concat(F.lit("head"), key)), body, pick(VARY_SUFFIX, F.concat(F.lit("tail"), key))))
    return case_and_punctuate(dressed, key, 0.10)


def dressed(s: Column, key: Column, prefixes: list[str], suffixes: list[str], question: float) -> Column:
    """The text with a prefix and a suffix of its mood, then case and end mark."""
    whole = F.concat(pick(prefixes, F.concat(F.lit("head"), key)), s, pick(suffixes, F.concat(F.lit("tail"), key)))
    return case_and_punctuate(collapse(whole), key, question)


def case_and_punctuate(s: Column, key: Column, question: float = 0.05) -> Column:
    """Of 100 texts 30 get a capital, 4 all capitals; a share ends in ?, of the rest 18 in 100 in . or !"""
    c, q, p = (draw(F.concat(F.lit(x), key), 1000) for x in ("case", "question", "point"))
    mark = F.when(q < int(question * 1000), "?").when(p < 90, ".").when(p < 180, "!").otherwise("")
    # the first letter or none, or all letters in capitals, so that the text stands here twice only
    cut = F.when(c < 300, 1).when(c < 340, 1 << 30).otherwise(0)
    return F.transform(F.array(s), lambda x: F.concat(F.upper(F.substring(x, F.lit(1), cut)), F.substring(x, cut + 1, F.lit(1 << 30)), mark))[0]


def truncate(s: Column, key: Column) -> Column:
    """Cut behind a word that leaves the text unfinished, or null if there is none."""
    words = F.split(F.trim(F.regexp_replace(s, r"[?.!,]+$", "")), r"\s+")
    dangling = F.array(*map(F.lit, DANGLING))
    inner = F.transform(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), lambda w, i: F.struct((i + 1).alias("i"), F.regexp_replace(F.lower(w), "^,+|,+$", "").alias("w")))
    spots = F.transform(F.filter(inner, lambda x: F.array_contains(dangling, x["w"])), lambda x: x["i"])
    chosen = F.get(spots, (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint") % F.greatest(F.lit(1), F.size(spots))).cast("int"))
    return F.when(F.size(spots) > 0, F.array_join(F.slice(words, 1, chosen), " "))


def interval_words(ms: Column) -> Column:
    """All plain wordings of an interval of milliseconds that we use, in order."""
    t = ms.cast("string")
    one = lambda n, word: F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s"))
    sec, minute, hertz = (ms / 1000).cast("int"), (ms / 60000).cast("int"), (F.lit(1000) / ms).cast("int")
    forms = [
        F.concat(F.lit("every "), t, F.lit(" ms")),
        F.concat(F.lit("every "), t, F.lit(" milliseconds")),
        F.when(ms % 1000 == 0, F.concat(F.lit("every "), sec.cast("string"), F.lit(" "), one(sec, "second"))),
        F.when(ms % 1000 == 500, F.concat(F.lit("every "), sec.cast("string"), F.lit(".5 seconds"))),
        F.when(ms % 60000 == 0, F.concat(F.lit("every "), minute.cast("string"), F.lit(" "), one(minute, "minute"))),
        F.when((ms > 0) & (F.lit(1000) % F.nullif(ms, F.lit(0)) == 0), F.concat(F.lit("at "), hertz.cast("string"), F.lit(" Hz"))),
        F.when(ms % 1000 == 0, F.concat(F.lit("every "), sec.cast("string"), F.lit(" s"))),
        F.when((ms > 0) & (F.lit(1000) % F.nullif(ms, F.lit(0)) == 0) & (ms < 1000), F.concat(hertz.cast("string"), F.lit(" times a second"))),
        F.when(ms == 100, "very fast").when(ms == 250, "fast").when(ms == 500, "twice a second").when(ms == 1000, "once a second").when(ms == 2000, "slowly"),
    ]
    return F.array_compact(F.array(*forms))


def count_words(n: Column) -> Column:
    """All wordings of a number of rounds; 0 is for ever."""
    t = n.cast("string")
    fixed = {0: ["", "forever", "without end"], 1: ["once", "one time"], 2: ["twice", "two times"], 3: ["three times", "thrice"]}
    out = F.array(F.concat(t, F.lit(" times")), F.concat(F.lit("for "), t, F.lit(" cycles")), F.concat(t, F.lit("x")))
    for k, words in fixed.items():
        out = F.when(n == k, F.array(*map(F.lit, words))).otherwise(out)
    return F.when(n.isNotNull(), out)


def span_tokens(text: Column, name: Column, tokens: Column) -> Column:
    """Ids of the tokens (struct id, s, e) that overlap the first place of a name in a text, whatever its ASCII case."""
    lo = F.position(F.lower(name), F.lower(text)) - 1
    hi = lo + F.length(name)
    return F.when(lo >= 0, F.transform(F.filter(tokens, lambda t: (t["e"] > lo) & (t["s"] < hi)), lambda t: t["id"]))
