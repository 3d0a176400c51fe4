"""Scoring of predictions by what they would do: one pass, one aggregate row; intervals and spread in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions import grammar as G
from loomery.functions.columns import free_name

Z = 1.96
OUTCOMES = ["correct", "refused", "refused_by_range", "refused_by_name", "wrong_action"]


def outcome(gold: Column, got: Column) -> Column:
    """What would happen; the order of the cases is part of the meaning."""
    names = G.names_of(got)
    return (
        F.when(G.frame_key(gold).eqNullSafe(G.frame_key(got)), "correct")
        .when(got.isNull() | (got["action"] == "unknown"), "refused")
        .when(G.range_verdict(got) != "execute", "refused_by_range")
        .when((F.size(names) > 0) & (names != G.names_of(gold)), "refused_by_name")
        .otherwise("wrong_action")
    )


def wilson(k: Column, n: Column) -> tuple[Column, Column, Column]:
    """Rate and Wilson bounds; all 0 without cases."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = k / n, Z * Z
    centre, spread = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (centre - spread) / (1 + z2 / n), (centre + spread) / (1 + z2 / n)
    return tuple(F.when(n.isNull(), 0.0).otherwise(c) for c in (p, F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))))


def with_interval(df: DataFrame, k: str, n: str) -> DataFrame:
    p, low, high = wilson(F.col(k), F.col(n))
    return df.withColumn("rate", p).withColumn("low", low).withColumn("high", high)


def judged(df: DataFrame, gold: str = "gold", got: str = "got") -> DataFrame:
    """df with outcome, and the flags that the rates count."""
    g, p = F.col(gold), F.col(got)
    valid = g["action"] != "unknown"
    runs = F.coalesce(G.runs(p), F.lit(False))
    return df.withColumns({
        "valid": valid,
        "outcome": outcome(g, p),
        "runs": runs,
        "malformed": p.isNull(),
        "loose": ~valid & (p.isNull() | (p["action"] != "unknown")),
        "false_accept": ~valid & runs,
        "has_pins": valid & (F.size(G.pins_of(g)) > 0),
        "pins_ok": valid & (F.size(G.pins_of(g)) > 0) & p.isNotNull() & (G.pins_of(p) == G.pins_of(g)),
        "unrunnable": valid & (G.range_verdict(g) != "execute"),
        "substituted": valid & (G.range_verdict(g) != "execute") & runs,
    })


def score(df: DataFrame, *by: str) -> DataFrame:
    """Counts of a judged table in one conditional aggregation, of all rows or by columns."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    valid, wrong = F.col("valid"), F.col("outcome") == "wrong_action"
    return df.groupBy(*by).agg(
        n(valid).alias("pos_n"), n(valid & (F.col("outcome") == "correct")).alias("pos_ok"), n(~valid).alias("neg_n"),
        n(F.col("false_accept")).alias("false_accepts"), n(F.col("loose")).alias("loose_accepts"), n(F.col("has_pins")).alias("pin_n"),
        n(F.col("pins_ok")).alias("pin_ok"), n(F.col("unrunnable")).alias("sub_n"), n(F.col("substituted")).alias("sub_hit"),
        n(F.col("malformed")).alias("malformed"), n(valid & wrong).alias("pos_danger"), n(~valid & wrong).alias("neg_danger"),
    )


def histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.when(F.col("valid"), "valid").otherwise("refusal").alias("half"), "outcome").agg(F.count(F.lit(1)).alias("n"))


def failure_lines(counts: DataFrame) -> DataFrame:
    """The histogram without what is correct, with each line's place in its half: in the order of OUTCOMES."""
    at = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    order = W.partitionBy("half").orderBy(at)  # a row for each outcome
    return counts.where("outcome <> 'correct' and n > 0").withColumn("place", F.row_number().over(order))


def samples(df: DataFrame, where: Column, by: str, limit: int, id_col: str) -> DataFrame:
    """The first failures of each kind, by id: a report, so the limit is its purpose."""
    order = W.partitionBy(by).orderBy(id_col)
    return df.where(where).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def open_details(df: DataFrame, locked: str = "locked", unlock: bool = False) -> bool:
    """May single rows be shown? Not while a locked row is among them, unless asked for."""
    return unlock or not df.select(F.coalesce(F.max(F.col(locked)), F.lit(False))).head()[0]


def spread(df: DataFrame, run: str, group: str, k: str, n: str) -> DataFrame:
    """Mean and half the range over runs of k / n (0 without cases); the spread of one run is null."""
    rate = free_name("run_rate", df)
    rates = df.withColumn(rate, F.col(k) / F.greatest(F.lit(1), F.col(n)))
    out = rates.groupBy(group).agg(
        F.count(run).alias("n_runs"), F.avg(rate).alias("mean_rate"),
        F.when(F.count(run) > 1, (F.max(rate) - F.min(rate)) / 2).alias("half_range"), F.max(n).alias("cases"),
    )
    return with_interval(out.withColumn("hits", F.bround(F.col("mean_rate") * F.col("cases")).cast("bigint")), "hits", "cases")


def sweep(df: DataFrame, run: str, group: str, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """spread() of several rates (name: hits and cases) at once: a row for each group and metric, in one pass over the runs."""
    many, hits, cases, metric = (free_name(c, df) for c in ("metric_rows", "metric_hits", "metric_cases", "metric"))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias(metric), F.col(k).cast("double").alias(hits), F.col(n).cast("bigint").alias(cases)) for m, (k, n) in metrics.items()]))
    long = df.select(run, F.col(group).alias(group), rows.alias(many)).select(run, F.struct(group, F.col(many)[metric].alias("metric")).alias(metric), F.col(many)[hits].alias(hits), F.col(many)[cases].alias(cases))
    out = spread(long, run, metric, hits, cases)
    return out.select(F.col(metric)[group].alias(group), F.col(metric)["metric"].alias("metric"), *[c for c in out.columns if c != metric])


def top1(values: Column) -> Column:
    """The place, from 0, of the largest element; of equal ones the first. Null for null and empty arrays; nulls are passed over."""
    return F.nullif(F.array_position(values, F.array_max(values)), F.lit(0)) - 1


def log_softmax(values: Column) -> Column:
    """The logarithms of the shares that numbers have as exponents, free of overflow; null for null and empty arrays."""
    low = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - low))
    return F.when(F.size(values) > 0, F.transform(values, lambda x: x - low - F.log(total)))


def mean_log_prob(steps: Column) -> Column:
    """The confidence of a greedy choice: over steps (arrays of numbers) the mean of the largest log share; 0 without steps."""
    best = F.transform(steps, lambda v: F.array_max(log_softmax(v)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(steps))


def predicted(df: DataFrame, predictor, text: str = "text", out: str = "predicted") -> DataFrame:
    """df with what a predictor says to its texts: it gets a list of texts, null ones empty, and gives as many strings or None.

    predictor() is called once a task and returns the function, so that a model is loaded where it runs. Of a taken column
    name the new one takes its place.
    """
    columns = [c for c in df.columns if c != out]
    at = columns.index(text)
    schema = df.select(*columns).schema.add(out, "string")

    def run(batches):
        import pyarrow as pa

        answer = predictor()
        for batch in batches:
            said = answer([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, out])

    return df.select(*columns).mapInArrow(run, schema)


def greedy(step, prompt: list[int], end: int, most: int = 40, width: int = 96, first: set[int] | None = None) -> tuple[list[int], float]:
    """The ids that a step function (ids so far: a number for each next id) leads to, and their mean log-probability.

    The prompt is cut to its last width - most ids. first, if given, are the only ids the answer may open with. It ends with
    the end id or after `most` ids; of equal numbers the first wins.
    """
    import math

    ids, out, total = prompt[-(width - most):], [], 0.0
    while len(out) < most:
        scores = list(step((ids + out)[-width:]))
        if first is not None and not out:
            scores = [x if i in first else -math.inf for i, x in enumerate(scores)]
        best = max(range(len(scores)), key=lambda i: (scores[i], -i))
        total -= math.log(sum(math.exp(x - scores[best]) for x in scores))
        out.append(best)
        if best == end:
            break
    return out, total / max(1, len(out))


def report(scored: DataFrame, details: dict[str, DataFrame], rows: DataFrame, locked: str = "locked", unlock: bool = False) -> DataFrame:
    """(section, label, value) for people to read: each number of scored, a table of one row, and the rows of details (label, value).

    While a locked row is among rows, the details are left out, unless unlock says otherwise.
    """
    number = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in scored.columns]))
    out = scored.select(F.lit("score").alias("section"), number.alias("x")).select("section", "x.label", "x.value")
    if open_details(rows, locked, unlock):
        for section, df in details.items():
            out = out.unionByName(df.select(F.lit(section).alias("section"), F.col("label").cast("string").alias("label"), F.col("value").cast("string").alias("value")))
    return out


def require_same(have: str, want: str, what: str) -> None:
    """Refuses an artefact that was made from other data or settings than those at hand."""
    if have != want:
        raise ValueError(f"{what} was made with {have}, but {want} is at hand: make it anew")


def line_diff(a: DataFrame, b: DataFrame, ordinal: list[str], line: str) -> DataFrame:
    """Two ordered streams side by side; a missing line is a difference."""
    x, y = a.select(*ordinal, F.col(line).alias("left_line")), b.select(*ordinal, F.col(line).alias("right_line"))
    return x.join(y, ordinal, "full").withColumn("same", F.col("left_line").eqNullSafe(F.col("right_line")))


def fingerprint(df: DataFrame, line: Column, order: str) -> DataFrame:
    """The first 16 hex digits of a SHA-256 over the lines in order; for tables of settings, not of data."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.agg(F.substring(F.sha2(F.array_join(F.transform(rows, lambda r: r["l"]), "\n"), 256), 1, 16).alias("fingerprint"))


def content_fingerprint(df: DataFrame, line: Column) -> DataFrame:
    """One of any size and order: the sum of the rows' hashes, and their number."""
    return df.agg(F.sum(F.xxhash64(line).cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))


def masked_mean(df: DataFrame, value: str, weight: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.lit(1.0), F.sum(weight))).alias("masked_mean"))


def learning_rate(step: Column, peak: float, warm: int, total: int, floor: float) -> Column:
    """Linear warm-up, then half a cosine down to a floor."""
    done = F.least(F.lit(1.0), (step - warm) / float(max(1, total - warm)))
    return F.when(step < warm, peak * (step + 1) / float(warm)).otherwise(floor + 0.5 * (peak - floor) * (1 + F.cos(F.pi() * done)))
