"""Generators of frames, utterances and corpora.

Every choice comes from a SHA-1 of seed, id and slot: the same in any partitioning, and in any engine that has SHA-1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import grammar as G
from loomery.functions import text as X
from loomery.functions.banks import SCALE, choice
from loomery.functions.columns import free_name, staged
from loomery.functions.templates import HEADS
from loomery.operators.curate import cut, first_wins, top_up
from loomery.operators.vocabulary import GROUP_NAME, KINDS, MOODS, NAME, REFUSALS
from loomery.sources.scratch import fixed

# Shares of the actions, of the kinds of refusals and of shapes.
ACTION_WEIGHTS = {"set": 38, "blink": 22, "read": 14, "stop": 12, "seq": 14, "alias": 8}
LEVEL_WEIGHTS = {"high": 45, "low": 45, "toggle": 10}
NEGATIVE_SHARE = 0.30
NEGATIVE_MIX = {"near": 0.23, "far": 0.26, "synthetic": 0.34, "truncated": 0.17}
NEAR_PINS = [0, 19, 20, 22, 23, 24, 27, 30, 35, 36, 37, 43, 44, 45, 46, 47, 49, 50]
ROUND_MS = [50, 100, 150, 200, 250, 300, 400, 500, 750, 1000, 1500, 2000, 2500, 3000, 4000, 5000, 6000, 7000, 8000, 9000, 10000]
LONG_MS = [11000, 12000, 15000, 20000, 25000, 30000, 40000, 45000, 50000, 60000, 75000, 90000, 120000, 180000]
MINUTES_MS = [120000, 180000, 240000, 300000, 600000]
COMMON_COUNTS = [0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 10, 12, 20]
SHARES = {
    "legal pin": 0.82, "odd interval": 0.10, "named": 0.30, "every": 0.08, "several": 0.18, "names": 0.14, "mixed": 0.06, "long chase": 0.10,
    "timed chase": 0.72, "group of chase": 0.70, "one pin named": 0.78, "bare stop": 0.45, "terse": 0.26,
}
# End of fixed values.

OVER = 3  # times as many rows are drawn as a quota wants
SOURCES = ["template", *NEGATIVE_MIX]

PIN_STYLES = ["pin {n}", "gpio {n}", "pin number {n}", "io {n}", "{n}"]
DETERMINERS = {"the ": 6, "my ": 2, "": 2, "that ": 1, "our ": 1}
EVERY = ["everything", "all of them", "every pin"]
JOINERS = [" and ", " plus ", " & "]
WHERE = {"": 14, " over there": 1, " by the door": 1, " upstairs": 1, " out back": 1, " next to the table": 1, " on this side": 1}


class Draws:
    """Choices for the slots of a row."""

    def __init__(self, seed: int, id_col: str = "id"):
        self.seed, self.id = seed, F.col(id_col)

    def key(self, slot: str | Column) -> Column:
        own = F.lit(f"|{slot}") if isinstance(slot, str) else F.concat(F.lit("|"), slot)
        return F.concat(F.lit(f"{self.seed}|"), F.coalesce(self.id.cast("string"), F.lit("")), own)

    def below(self, slot: str, n: int) -> Column:
        return X.draw(self.key(slot), n)

    def between(self, slot: str, low: int, high: int) -> Column:
        return (self.below(slot, high - low + 1) + low).cast("int")

    def chance(self, slot: str, share: float) -> Column:
        return self.below(slot, SCALE) < int(share * SCALE)

    def one_of(self, slot: str, options: list) -> Column:
        return F.element_at(X.listed(options), (self.below(slot, len(options)) + 1).cast("int"))

    def weighted(self, slot: str, weights: dict[str, float]) -> Column:
        return choice(weights, self.key(slot))


def numbered(slot: str, i: Column) -> Column:
    return F.concat(F.lit(slot), i.cast("string"))


def pin_number(d: Draws, slot: str | Column) -> Column:
    """82 of 100 on the board; of the rest 55 near its pins, 25 elsewhere below 60, 20 with three digits."""
    of = lambda x: slot + x if isinstance(slot, str) else F.concat(slot, F.lit(x))
    kind = d.below(of("k"), 100)
    far = [n for n in range(60) if n not in G.PINS_S3]
    odd = F.when(kind < 55, d.one_of(of("n"), NEAR_PINS)).when(kind < 80, d.one_of(of("f"), far)).otherwise(d.between(of("t"), 100, 199))
    return F.when(d.chance(of("legal"), SHARES["legal pin"]), d.one_of(of("p"), G.PINS_S3)).otherwise(odd).cast("int")


def interval(d: Draws) -> Column:
    """One in ten outside the bounds: too short, or too long in seconds, minutes or anyhow; most of the others round."""
    kind = d.below("ik", 100)
    high = F.when(kind < 55, d.one_of("il", LONG_MS)).when(kind < 75, d.one_of("im", MINUTES_MS)).otherwise(d.between("ia", G.INTERVAL_MAX + 1, 200_000))
    odd = F.when(d.chance("is", 0.4), d.between("iw", 1, G.INTERVAL_MIN - 1)).otherwise(high)
    fine = F.when(d.chance("iq", 0.75), d.one_of("ir", ROUND_MS)).otherwise(d.between("iu", G.INTERVAL_MIN, G.INTERVAL_MAX))
    return F.when(d.chance("io", SHARES["odd interval"]), odd).otherwise(fine).cast("int")


def count(d: Draws) -> Column:
    return F.when(d.chance("cc", 0.85), d.one_of("cn", COMMON_COUNTS)).otherwise(d.between("cu", 1, 99)).cast("int")


def name(d: Draws, slot: str) -> Column:
    return NAME.column(d.key(slot))


def group_name(d: Draws, slot: str) -> Column:
    return GROUP_NAME.column(d.key(slot))


def _target(kind: str, n: Column | None = None, s: Column | None = None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit(kind).alias("kind"), (null("int") if n is None else n).alias("n"), (null("string") if s is None else s).alias("s"))


def frames(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(id, frame): n well-shaped frames."""
    return with_frames(spark.range(n), seed)


def spread(df: DataFrame) -> DataFrame:
    """Ids dealt evenly to as many tasks as the session has: a draw costs far more than its id, and a small file of ids is one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_frames(df: DataFrame, seed: int = 1) -> DataFrame:
    """(id, frame) for each id, in steps so that each draw is made once."""
    d = Draws(seed)
    df = spread(df.select("id"))
    as_pins = lambda numbers: F.transform(numbers, lambda x: _target("pin", x.cast("int")))
    df = df.select(
        "id", d.weighted("action", ACTION_WEIGHTS).alias("a"), d.chance("named", SHARES["named"]).alias("named"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: pin_number(d, numbered("m", i))).alias("numbers"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: NAME.column(d.key(numbered("name", i)))).alias("words"), group_name(d, "group").alias("group"),
        F.when(d.chance("long", SHARES["long chase"]), d.between("longer", G.MAX_SEQ_PINS + 1, G.MAX_SEQ_PINS + 4)).otherwise(d.between("chase", 2, G.MAX_SEQ_PINS)).alias("chase"),
    )
    df = staged(df)
    board = X.listed(G.PINS_S3)
    as_names = lambda many: F.transform(F.slice("words", F.lit(1), many), lambda x: _target("name", s=x))
    one_name, one_pin = F.array(_target("name", s=F.get("words", F.lit(0)))), as_pins(F.slice("numbers", 1, 1))
    named = (
        F.when(d.chance("names", SHARES["names"]), as_names(d.between("many names", 2, 3)))
        .when(d.chance("mixed", SHARES["mixed"]), F.when(d.chance("turned", 0.5), F.concat(one_name, one_pin)).otherwise(F.concat(one_pin, one_name)))
        .otherwise(one_name)
    )
    plain = F.when(d.chance("several", SHARES["several"]), as_pins(F.slice("numbers", F.lit(1), d.between("many", 2, G.MAX_SEQ_PINS)))).otherwise(one_pin)
    every = d.chance("every", SHARES["every"]) & F.col("a").isin("set", "blink")
    listed = F.when(F.col("named"), named).when(every, F.array(_target("all"))).otherwise(plain)
    # a chase runs along the board, or over some of its pins in order, or anywhere
    start = d.below("start", 1 << 30) % (F.size(board) - F.col("chase") + 1)
    shuffled = F.array_sort(F.transform(board, lambda p: F.struct(F.sha1(F.concat(d.key("sample"), p.cast("string"))).alias("h"), p.alias("p"))))
    sampled = F.array_sort(F.transform(F.slice(shuffled, F.lit(1), F.col("chase")), lambda x: x["p"]))
    path = d.below("path", 100)
    chased = F.when(path < 50, F.slice(board, start.cast("int") + 1, F.col("chase"))).when(path < 70, sampled).otherwise(F.slice("numbers", F.lit(1), F.col("chase")))
    named_chase = F.when(d.chance("group", SHARES["group of chase"]), F.array(_target("name", s=F.col("group")))).otherwise(as_names(d.between("chase names", 2, 3)))
    # distinct pins and a name, of a group where there are several
    own = F.slice(F.array_distinct("numbers"), F.lit(1), F.when(d.chance("one", SHARES["one pin named"]), 1).otherwise(d.between("given", 2, 4)))
    given = F.concat(as_pins(own), F.array(_target("name", s=F.when(F.size(own) > 1, F.col("group")).otherwise(F.get("words", F.lit(0))))))
    a, roll = F.col("a"), d.below("roll", 100)
    targets = (
        F.when(a == "seq", F.when(F.col("named"), named_chase).otherwise(as_pins(chased)))
        .when(a == "alias", given)
        .when((a == "stop") & d.chance("bare", SHARES["bare stop"]), F.slice(one_pin, 1, 0))
        .otherwise(listed)
    )
    timed = ((a == "blink") & (roll < 70)) | ((a == "seq") & d.chance("timed", SHARES["timed chase"]))
    rounds = F.when(timed, count(d)).when((a == "blink") & (roll < 84), d.between("blinks", 1, 20))
    frame = F.struct(
        a.alias("action"), targets.alias("targets"), F.when(a == "set", d.weighted("level", LEVEL_WEIGHTS)).alias("level"), F.when(timed, interval(d)).alias("interval_ms"), rounds.alias("count")
    )
    return staged(df.select("id", frame.alias("frame")))


def realize(df: DataFrame, seed: int = 1) -> DataFrame:
    """df (id, frame, ...) with text: each frame in words, in one style a row, a quarter of them in a machine's register."""
    d = Draws(seed)
    said_, ref_, style_, head_, terse_, mood_, tail_ = (free_name(c, df) for c in ("said", "ref", "style", "head", "terse", "mood", "tail"))
    f = F.col("frame")
    rows = staged(df.withColumn(style_, F.struct(d.one_of("pin style", PIN_STYLES).alias("pin"), d.weighted("determiner", DETERMINERS).alias("det"), d.one_of("every word", EVERY).alias("all"), d.one_of("joiner", JOINERS).alias("and"))))
    style = F.col(style_)
    said = F.transform(f["targets"], lambda t: F.when(t["kind"] == "all", style["all"]).when(t["kind"] == "pin", F.replace(style["pin"], F.lit("{n}"), t["n"].cast("string"))).otherwise(F.concat(style["det"], t["s"])))
    rows = staged(rows.withColumn(said_, said))
    many = F.size(said_)
    joined = F.when(many < 2, F.array_join(said_, "")).otherwise(F.concat(F.array_join(F.slice(said_, F.lit(1), F.greatest(F.lit(1), many - 1)), ", "), style["and"], F.get(said_, many - 1)))
    named = F.concat(F.array_join(F.slice(said_, F.lit(1), F.greatest(F.lit(0), many - 1)), ", "), F.lit(" is "), F.get(said_, many - 1))
    rows = rows.withColumn(ref_, F.when(many == 0, "it all").when(f["action"] == "alias", named).otherwise(joined))
    head = F.lit(None).cast("string")
    for action, bank in HEADS.items():
        for level, forms in bank.items() if isinstance(bank, dict) else [(None, bank)]:
            head = F.when((f["action"] == action) & (F.lit(True) if level is None else f["level"] == level), X.pick(forms, d.key("head"))).otherwise(head)
    rows = staged(rows.withColumn(head_, head))
    wordings = lambda options, slot: F.get(options, (d.below(slot, 1 << 30) % F.greatest(F.lit(1), F.size(options))).cast("int"))
    rows = rows.withColumn(tail_, F.struct(wordings(X.interval_words(f["interval_ms"]), "rate words").alias("ms"), wordings(X.count_words(f["count"]), "count words").alias("times")))
    rows = staged(rows)
    body = F.concat_ws(" ", F.concat(F.replace(head_, F.lit("{r}"), F.col(ref_)), F.when(f["action"].isin("set", "read"), d.weighted("where", WHERE)).otherwise("")), F.col(tail_)["ms"], F.nullif(F.col(tail_)["times"], F.lit("")))
    short = F.transform(f["targets"], lambda t: F.when(t["kind"] == "all", "all").when(t["kind"] == "pin", t["n"].cast("string")).otherwise(t["s"]))
    terse = F.concat_ws(" ", f["action"], F.array_join(short, " "), f["level"], F.concat(f["interval_ms"].cast("string"), F.lit("ms")), F.concat(F.lit("x"), f["count"].cast("string")))
    rows = rows.withColumn(terse_, d.chance("terse", SHARES["terse"]))
    rows = rows.withColumn(mood_, F.when(F.col(terse_), "terse").when(F.col(head_).rlike("^(what does|is|does) "), "question").when(F.col(head_).startswith("{r}"), "bare").otherwise("imperative"))
    return decorated(staged(rows.withColumn("text", F.when(F.col(terse_), terse).otherwise(body))), mood_, d.key("dress")).drop(said_, ref_, style_, head_, terse_, mood_, tail_)


def decorated(df: DataFrame, mood: str, key: Column) -> DataFrame:
    """df with its text dressed in its mood."""
    out = F.col("text")
    for m, (prefixes, suffixes, question) in MOODS.items():
        out = F.when(F.col(mood) == m, X.dressed(F.col("text"), key, prefixes, suffixes, question)).otherwise(out)
    return staged(df.withColumn("text", out))


def negatives(df: DataFrame, seed: int = 1) -> DataFrame:
    """df (id, ...) with generator and text: utterances to refuse, of eight generators and five banks by weight."""
    d = Draws(seed)
    kind, mood = free_name("generator", df), free_name("mood", df)
    text = said_as = F.lit(None).cast("string")
    for k, (bank, m) in REFUSALS.items():
        text = F.when(F.col(kind) == k, bank.column(d.key(k))).otherwise(text)
        said_as = F.when(F.col(kind) == k, m).otherwise(said_as)
    rows = staged(staged(df.withColumn(kind, d.weighted("generator", KINDS))).withColumn("text", text).withColumn(mood, said_as))
    return decorated(rows, mood, d.key("dress")).drop(mood)


def filled(df: DataFrame, by: str, quotas: dict[str, int]) -> DataFrame:
    """Rows of each group, as many as its quota: by turn (the upper half of id), then by a hash of id and text. The limit is the purpose."""
    limit = F.lit(0)
    for k, n in quotas.items():
        limit = F.when(F.col(by) == k, n).otherwise(limit)
    key = F.concat_ws("|", F.col("id").cast("string"), "text")
    return cut(df, by, limit, key, "id", tier=F.greatest(F.lit(0), F.shiftright("id", 32)))


def refusal_rows(df: DataFrame) -> DataFrame:
    """df (text, source, ...) as rows whose label is to refuse, with the flags of held-out rows where df has them."""
    flags = {"stratum": "string", "in_train": "boolean", "v2_class": "string", "v2_deferred": "boolean", "locked": "boolean"}
    label = F.array(F.lit("<unknown>"), F.lit("<end>"))
    own = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in flags.items()]
    return df.select("text", label.alias("symbols"), F.lit("unknown").alias("action"), "source", *own)


def corpus(spark: SparkSession, n: int, seed: int = 1, pools: dict[str, DataFrame] | None = None, over: int = OVER) -> DataFrame:
    """(text, symbols, action, source): n rows, one a normalised text, NEGATIVE_SHARE of them to refuse, by NEGATIVE_MIX.

    over times as many as wanted are drawn, repeated texts go (commands win over refusals, and sources in the order of the
    mix), and each source is filled to its quota by id. What then is missing is missing because the templates have too few
    texts: short() says so. pools has the texts (text) of outside utterances for the sources near and far, which come first
    and are topped up by dressing them anew; without it generators stand in.
    """
    quotas, pools = quotas_of(n), pools or {}
    source = F.element_at(X.listed(SOURCES), (F.shiftright("id", 40) + 1).cast("int"))
    refused = F.lit("<unknown>\x1f<end>")
    # commands, and those cut short, in one go: a row's source is in its id
    said = realize(with_frames(_ids(spark, {"template": over * quotas["template"], "truncated": 2 * over * quotas["truncated"]}), seed), seed)
    whole = source == "template"
    every = said.select(
        "id", F.when(whole, F.col("text")).otherwise(X.truncate(F.col("text"), Draws(seed).key("cut"))).alias("text"),
        F.when(whole, F.array_join(G.to_symbols(F.col("frame")), "\x1f")).otherwise(refused).alias("label"), F.when(whole, F.col("frame.action")).otherwise("unknown").alias("action"),
    )
    made = {k: over * quotas[k] for k in NEGATIVE_MIX if k != "truncated" and k not in pools}
    parts = [negatives(_ids(spark, made), seed).select("id", "text")] if made else []
    parts += [_of_pool(pool, over * quotas[k]).select((F.col("id") + (SOURCES.index(k) << 40)).alias("id"), "text") for k, pool in pools.items()]
    for part in parts:
        every = every.unionByName(part.select("id", "text", refused.alias("label"), F.lit("unknown").alias("action")))
    every = every.withColumn("source", source).withColumn("prio", F.shiftright("id", 40))
    out = filled(fixed(first_wins(every, X.dedup_key(F.col("text")), "prio", "id", drop_blank=True)), "source", quotas)  # drawn once
    return out.select("text", F.split("label", "\x1f").alias("symbols"), "action", "source")


def _ids(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(id): as many ids of each source as it wants, the source's place in front."""
    out = None
    for k, n in counts.items():
        part = spark.range(n).select((F.col("id") + (SOURCES.index(k) << 40)).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def quotas_of(n: int) -> dict[str, int]:
    """How many rows of n each source has."""
    n_neg = int(n * NEGATIVE_SHARE)
    return {"template": n - n_neg, **{k: int(n_neg * share) for k, share in NEGATIVE_MIX.items()}}


def short(rows: DataFrame, n: int) -> dict[str, int]:
    """How many rows of n each source lacks, those that lack none left out."""
    got = {r.source: r.n for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {k: want - got.get(k, 0) for k, want in quotas_of(n).items() if got.get(k, 0) < want}


def _of_pool(pool: DataFrame, n: int) -> DataFrame:
    """(id, text): n texts of a pool, its own first, then dressed anew; the turn is the id's upper half."""
    texts = first_wins(pool.select("text"), X.dedup_key(F.col("text")), "text", drop_blank=True).withColumn("pool", F.lit(0))
    rows = staged(top_up(texts, "pool", n, F.sha1("text"), "text", "text"))
    return rows.select((F.col("turn") * (1 << 32) + X.draw(F.concat(F.lit("order"), F.sha1("text")), 1 << 32)).alias("id"), "text")
