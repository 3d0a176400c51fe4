"""Queries over the driver's tables, by name, each with its SQL for comparison.

documents stands for utterances, labels for labels, benchmark for the held-out set; commands are derived from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions import grammar as G
from loomery.functions import text as X
from loomery.functions.columns import staged
from loomery.functions.banks import sql_choice, sql_draw
from loomery.operators import alias as A
from loomery.operators import curate as C
from loomery.operators import evaluate as E
from loomery.operators import bytepairs as B
from loomery.operators import generate as N
from loomery.operators import ordinals as O
from loomery.operators import pack as P
from loomery.operators import vocabulary as V
from loomery.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# SQL twins of the text kernel, for DuckDB.
def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_key(s: str) -> str:
    return f"regexp_replace(lower({s}), '^\\s+|\\s+$', '', 'g')"


def sql_collapse(s: str) -> str:
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def sql_clean(s: str) -> str:
    return f"regexp_replace({sql_collapse(f"regexp_replace({s}, '{X.WAKE_WORDS}', ' ', 'g')")}, '^[ ,]+|[ ,]+$', '', 'g')"


def sql_part_key(s: str) -> str:
    head = f"regexp_replace({sql_key(s)}, '{X.LEAD_PREFIX}', '')"
    return sql_collapse(f"regexp_replace(regexp_replace({head}, '{X.VARY_TAIL}', ''), '^[ .,!?]+|[ .,!?]+$', '', 'g')")


FIRST = "select * from documents qualify row_number() over (partition by {key} order by doc_id) = 1"
WILSON = """
  coalesce(p, 0) as rate,
  coalesce(greatest((p + 3.8416e0 / (2 * n) - 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4e0 * n * n))) / (1 + 3.8416e0 / n), 0), 0) as low,
  coalesce(least((p + 3.8416e0 / (2 * n) + 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4e0 * n * n))) / (1 + 3.8416e0 / n), 1), 0) as high
"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def near_miss(spark, sf_dir: str) -> DataFrame:
    """Documents cleaned, keyed and split, the first of each text: flags and a digest are taken first, so no text is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", X.clean(F.col("text")).alias("text"))
    split = C.split_rows(docs).select("doc_id", "lang", "part", F.sha1(X.dedup_key(F.col("text"))).alias("digest"))
    return C.first_wins(split, F.col("digest"), "doc_id")


@query(f"""
with c as (select doc_id, lang, {sql_clean("text")} as text from documents),
d as (select * from c qualify row_number() over (partition by {sql_key("text")} order by doc_id) = 1)
select lang, case when {sql_draw(sql_part_key("text"), 10)} >= 4 then 'train'
  when {sql_draw(sql_part_key("'locked:' || text"), 10)} < 4 then 'locked' else 'dev' end as part, count(*) as n
from d group by all""")
def split_by_lang(spark, sf_dir):
    return near_miss(spark, sf_dir).groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, sha1({sql_clean('text')}) as cleaned from documents")
def clean_wake_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(X.clean(F.col("text"))).alias("cleaned"))


@query(f"select doc_id, lang from ({FIRST.format(key=sql_key('text'))})")
def dedup_first_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha1(X.dedup_key(F.col("text"))).alias("digest"))
    return C.first_wins(docs, F.col("digest"), "doc_id").select("doc_id", "lang")


@query(f"select doc_id, sha1({sql_part_key('text')}) as key_sha1, {sql_draw(sql_part_key('text'), 10)} as bucket from documents")
def partition_bucket(spark, sf_dir):
    key = X.partition_key(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(key).alias("key_sha1"), X.bucket10(key).alias("bucket"))


@query(f"select {sql_draw(sql_part_key('text'), 10)} < 4 as held_out, count(*) as n, count(distinct {sql_part_key('text')}) as keys from documents group by 1")
def holdout_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(X.is_held_out(F.col("text")).alias("held_out"), F.sha1(X.partition_key(F.col("text"))).alias("k"))
    return docs.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("keys"))


@query(f"""select doc_id, {sql_draw(sql_part_key("'locked:' || text"), 10)} < 4 as locked from documents where {sql_draw(sql_part_key('text'), 10)} < 4""")
def locked_dev_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(X.is_held_out(F.col("text"))).select("doc_id", X.is_locked(F.col("text")).alias("locked"))


@query(f"""
with d as ({FIRST.format(key=sql_key('text'))})
select d.doc_id, bool_or(coalesce(l.toxic = 1, false)) over (partition by {sql_part_key('text')}) as held
from d left join labels l on d.doc_id = l.doc_id""")
def side_or_by_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1(X.dedup_key(F.col("text"))).alias("digest"), F.sha1(X.partition_key(F.col("text"))).alias("part"))
    rows = C.first_wins(docs, F.col("digest"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return C.any_of_key(rows, F.col("part"), F.coalesce(F.col("toxic") == 1, F.lit(False)), "held").select("doc_id", "held")


@query(f"""
select sum(cast(a and b as int)) as shared_keys, count(*) as keys from (
  select {sql_part_key('text')} as k, bool_or({sql_draw(sql_part_key('text'), 10)} < 4) as a,
         bool_or({sql_draw(sql_part_key('text'), 10)} >= 4) as b from documents group by 1)""")
def disjoint_sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha1(X.partition_key(F.col("text"))).alias("k"), X.is_held_out(F.col("text")).alias("h"))
    keys = docs.groupBy("k").agg(F.bool_or("h").alias("a"), F.bool_or(~F.col("h")).alias("b"))
    return keys.agg(F.sum((F.col("a") & F.col("b")).cast("int")).alias("shared_keys"), F.count(F.lit(1)).alias("keys"))


@query("""
with c as (select event_type, count(*) as n, min(event_id) as first_seen from events group by 1)
select event_type, n, round(n / sum(n) over (), 9) as share, row_number() over (order by n desc, first_seen) as place from c""")
def action_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen"))
    from pyspark.sql import Window as W

    out = counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())).withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "first_seen")))
    return rounded(out.select("event_type", "n", "share", "place"), "share")


@query(f"""
with c as (select lang, count(*) as n, sum(l.quality) as k from documents join labels l using (doc_id) group by 1),
r as (select lang, k, n, k / n as p from c), w as (select lang, k, n, {WILSON} from r)
select lang, cast(k as bigint) as hits, n as cases, round(rate, 9) as rate, round(low, 9) as low, round(high, 9) as high from w""")
def wilson_by_lang(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    counts = rows.groupBy("lang").agg(F.sum("quality").alias("hits"), F.count(F.lit(1)).alias("cases"))
    return rounded(E.with_interval(counts, "hits", "cases"), "rate", "low", "high")


# Commands: a line of symbols for each event, legal and not.
_DIGITS = {"spark": "trim(regexp_replace(cast({} as string), '([0-9])', '$1 '))", "duck": "trim(regexp_replace(cast({} as varchar), '([0-9])', '\\1 ', 'g'))"}


def sql_commands(dialect: str) -> str:
    d = _DIGITS[dialect].format
    pins = " || ".join(f"case when {i} < event_id % 9 then ' <pin> ' || {d(f'(user_id * {i + 3} + event_id) % 50')} else '' end" for i in range(8))
    return f"""
    select event_id, user_id, event_type, case event_id % 11
      when 0 then '<set> <pin> ' || {d('user_id % 120')} || ' <high> <end>'
      when 1 then '<set> <pin> ' || {d('user_id % 50')} || ' <pin> ' || {d('event_id % 50')} || ' <low> <end>'
      when 2 then '<blink> <pin> ' || {d('user_id % 50')} || ' <int> ' || {d('(event_id * 7) % 12000')} || ' <cnt> ' || {d('event_id % 12')} || ' <end>'
      when 3 then '<seq>' || {pins} || ' <end>'
      when 4 then case when user_id % 2 = 0 then '<stop> <end>' else '<stop> <all> <end>' end
      when 5 then '<read> <pin> ' || {d('event_id * 1003 % 2000000')} || ' <end>'
      when 6 then '<alias> <pin> ' || {d('user_id % 40')} || ' <name> ' || event_type || ' Lamp <nend> <end>'
      when 7 then '<unknown> <end>'
      when 8 then '<set> <name> ' || event_type || '_lights <nend> <toggle> <end>'
      when 9 then '<blink> <all> <int> ' || {d('event_id % 900')} || ' <end>'
      else '<set> <all> <pin> 4 <high> <end>' end as cmd from events"""


def commands(spark, sf_dir: str) -> DataFrame:
    lines = spark.sql(sql_commands("spark").replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    return G.with_frame(lines, "cmd")


_RX = _q(G.COMMAND)
_INT = lambda s: f"try_cast(replace({s}, ' ', '') as int)"
SQL_PARSED = f"""
  c as ({sql_commands("duck")}),
  m as (select *, regexp_matches(cmd, '{_RX}') as fits, regexp_extract(cmd, '{_RX}', 1) as act, regexp_extract(cmd, '{_RX}', 2) as tg,
        nullif(regexp_extract(cmd, '{_RX}', 3), '') as lvl, {_INT(f"regexp_extract(cmd, '{_RX}', 4)")} as ms, {_INT(f"regexp_extract(cmd, '{_RX}', 5)")} as cnt from c),
  t as (select *, regexp_extract_all(tg, '<pin>((?: [0-9])+)', 1) as pin_text, len(regexp_extract_all(tg, '<(all|pin|name)>')) as n,
        tg like '%<all>%' as every, len(regexp_extract_all(tg, '<name>')) as names from m),
  p as (select *, list_transform(pin_text, lambda x: {_INT('x')}) as pins, cmd = '<unknown> <end>' or (fits and case act
      when 'set' then n >= 1 and not (every and n > 1) and lvl is not null and ms is null and cnt is null
      when 'read' then n >= 1 and not every and lvl is null
      when 'blink' then n >= 1 and not (every and n > 1) and not (ms is not null and cnt is null)
      when 'seq' then (n >= 2 or names > 0) and not every and not (ms is not null and cnt is null)
      when 'stop' then not every and lvl is null and ms is null
      when 'alias' then names = 1 and n >= 2 and not every and lvl is null and ms is null and cnt is null
      else false end) as ok from t),
  v as (select *, case when cmd = '<unknown> <end>' then 'execute'
      when len(list_filter(pins, lambda x: not list_contains({G.PINS_S3}, x))) > 0 then 'bad_pin'
      when act = 'seq' and n > 6 then 'too_many_pins' when ms is not null and (ms < 50 or ms > 10000) then 'bad_interval' else 'execute' end as verdict from p)
"""


@query(f"""with {SQL_PARSED} select event_id, ok as parsed, case when ok then case when act = '' then 'unknown' else act end end as action,
  case when ok then array_to_string(pins, ',') end as pins, case when ok then lvl end as level, case when ok then ms end as interval_ms, case when ok then cnt end as rounds from v""")
def parse_symbols(spark, sf_dir):
    f = F.col("frame")
    return commands(spark, sf_dir).select(
        "event_id", f.isNotNull().alias("parsed"), f["action"].alias("action"), F.when(f.isNotNull(), F.array_join(G.pins_of(f), ",")).alias("pins"),
        f["level"].alias("level"), f["interval_ms"].alias("interval_ms"), f["count"].alias("rounds"),
    )


@query(f"with {SQL_PARSED} select case when not fits and cmd <> '<unknown> <end>' then 'malformed' when ok then 'fits' else 'wrong shape' end as state, count(*) as n from v group by 1")
def shape_rules(spark, sf_dir):
    fits = F.col("cmd").rlike(G.COMMAND) | (F.col("cmd") == "<unknown> <end>")
    state = F.when(~fits, "malformed").when(F.col("frame").isNotNull(), "fits").otherwise("wrong shape")
    return commands(spark, sf_dir).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_PARSED} select case when act = '' then 'unknown' else act end as action, verdict, count(*) as n from v where ok group by all")
def range_verdict(spark, sf_dir):
    rows = commands(spark, sf_dir).where("frame is not null")
    return rows.groupBy(F.col("frame.action").alias("action"), G.range_verdict(F.col("frame")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_PARSED} select event_id, true as same from v where ok")
def roundtrip_frames(spark, sf_dir):
    rows = commands(spark, sf_dir).where("frame is not null")
    return rows.select("event_id", (F.array_join(G.to_symbols(F.col("frame")), " ") == F.col("cmd")).alias("same"))


# Predictions: the gold command of the event three ids on, or nothing, by hash.
def judged(spark, sf_dir: str) -> DataFrame:
    rows = commands(spark, sf_dir)
    other = rows.select((F.col("event_id") - 3).alias("event_id"), F.col("frame").alias("other"))
    pick = X.draw(F.col("event_id").cast("string"), 10)
    gold = rows.where("frame is not null").select("event_id", "user_id", "event_type", F.col("frame").alias("gold")).join(other, "event_id", "left")
    return staged(E.judged(staged(gold.withColumn("got", F.when(pick < 6, F.col("gold")).when(pick < 9, F.col("other"))))))


SQL_JUDGED = f"""{SQL_PARSED},
  g as (select a.event_id, a.user_id, a.event_type, case when a.act = '' then 'unknown' else a.act end as ga, a.cmd as gc, a.pins as gp, a.verdict as gv, regexp_extract(a.tg, '<name> ([^<>]*) <nend>', 1) as gn,
      {sql_draw('cast(a.event_id as varchar)', 10)} as d, b.ok as bok, case when b.act = '' then 'unknown' else b.act end as ba, b.cmd as bc, b.pins as bp, b.verdict as bv, regexp_extract(b.tg, '<name> ([^<>]*) <nend>', 1) as bn
    from v a left join v b on b.event_id = a.event_id + 3 where a.ok),
  h as (select *, case when d < 6 then true when d < 9 then coalesce(bok, false) else false end as has, d < 6 as own from g),
  k as (select *, case when own then ga when has then ba end as pa, case when own then gc when has then bc end as pc, case when own then gp when has then bp end as pp,
      case when own then gv when has then bv end as pv, case when own then gn when has then bn end as pn from h),
  norm as (select *, lower(replace(coalesce(pn, ''), '_', ' ')) as pnn, lower(replace(coalesce(gn, ''), '_', ' ')) as gnn from k),
  j as (select *, ga <> 'unknown' as valid, has and pa <> 'unknown' and pv = 'execute' as runs,
      case when has and lower(replace(pc, '_', ' ')) = lower(replace(gc, '_', ' ')) then 'correct' when not has or pa = 'unknown' then 'refused'
        when pv <> 'execute' then 'refused_by_range' when pnn <> '' and pnn <> gnn then 'refused_by_name' else 'wrong_action' end as outcome from norm)
"""
_SCORE = """count(*) filter (valid) as pos_n, count(*) filter (valid and outcome = 'correct') as pos_ok, count(*) filter (not valid) as neg_n,
  count(*) filter (not valid and runs) as false_accepts, count(*) filter (not valid and (not has or pa <> 'unknown')) as loose_accepts,
  count(*) filter (valid and len(gp) > 0) as pin_n, count(*) filter (valid and len(gp) > 0 and has and pp = gp) as pin_ok,
  count(*) filter (valid and gv <> 'execute') as sub_n, count(*) filter (valid and gv <> 'execute' and runs) as sub_hit,
  count(*) filter (not has) as malformed, count(*) filter (valid and outcome = 'wrong_action') as pos_danger,
  count(*) filter (not valid and outcome = 'wrong_action') as neg_danger"""


@query(f"with {SQL_JUDGED} select {_SCORE} from j")
def score_one_pass(spark, sf_dir):
    return E.score(judged(spark, sf_dir))


@query(f"with {SQL_JUDGED} select case when valid then 'valid' else 'refusal' end as half, outcome, count(*) as n from j group by all")
def outcome_histogram(spark, sf_dir):
    return E.histogram(judged(spark, sf_dir))


@query(f"with {SQL_JUDGED} select ga as action, {_SCORE} from j group by 1")
def accuracy_by_action(spark, sf_dir):
    return E.score(judged(spark, sf_dir).withColumn("action", F.col("gold.action")), "action")


@query(f"""with {SQL_JUDGED} select coalesce(nullif(case when event_type = 'click' then '' else event_type end, ''), 'source ' || user_id % 3) as stratum,
  count(*) filter (runs) as accepted, count(*) as cases from j where not valid group by 1""")
def false_accept_by_stratum(spark, sf_dir):
    stratum = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    name = F.coalesce(F.nullif(stratum, F.lit("")), F.concat(F.lit("source "), (F.col("user_id") % 3).cast("string")))
    rows = judged(spark, sf_dir).where(~F.col("valid"))
    return rows.groupBy(name.alias("stratum")).agg(F.count_if("false_accept").alias("accepted"), F.count(F.lit(1)).alias("cases"))


@query(f"""with {SQL_JUDGED} select outcome, event_id, row_number() over (partition by outcome order by event_id) as nth from j where outcome <> 'correct' qualify nth <= 8""")
def bounded_samples(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return E.samples(rows, F.col("outcome") != "correct", "outcome", 8, "event_id").select("outcome", "event_id", "nth")


@query(f"""
with {SQL_JUDGED}, r as (select event_type, user_id % 5 as run, count(*) filter (valid and outcome = 'correct') as ok, count(*) filter (valid) as n from j group by all),
s as (select event_type, count(*) as n_runs, avg(ok / greatest(1, n)) as mean_rate, case when count(*) > 1 then (max(ok / greatest(1, n)) - min(ok / greatest(1, n))) / 2 end as half_range, max(n) as n from r group by 1),
s2 as (select *, cast(round_even(mean_rate * n, 0) as bigint) as hits from s), i as (select *, hits / nullif(n, 0) as p from s2)
select event_type, n_runs, round(mean_rate, 9) as mean_rate, round(half_range, 9) as half_range, hits, n as cases, round(rate, 9) as rate, round(low, 9) as low, round(high, 9) as high
from (select *, {WILSON} from i)""")
def seed_spread(spark, sf_dir):
    runs = E.score(judged(spark, sf_dir).withColumn("run", F.col("user_id") % 5), "event_type", "run")
    return rounded(E.spread(runs, "run", "event_type", "pos_ok", "pos_n"), "mean_rate", "half_range", "rate", "low", "high")


@query("""
with r as (select distinct user_id % 5 as run from events), s as (select distinct event_type as split from events),
k as (select user_id % 5 as run, event_type as split, count(*) as n, count(*) filter (value > 50) as hits from events group by all)
select r.run, s.split, coalesce(n, 0) as n, round(coalesce(hits, 0) / greatest(1, coalesce(n, 0)), 9) as rate from r cross join s left join k on k.run = r.run and k.split = s.split""")
def run_split_matrix(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("split"), "value")
    grid = events.select("run").distinct().crossJoin(events.select("split").distinct())
    counts = events.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("hits"))
    out = grid.join(counts, ["run", "split"], "left")
    n = F.coalesce("n", F.lit(0))
    return rounded(out.select("run", "split", n.alias("n"), (F.coalesce("hits", F.lit(0)) / F.greatest(F.lit(1), n)).alias("rate")), "rate")


@query(f"select lang, count(*) as n, count(*) filter ({sql_key('text')} in (select {sql_key('text')} from benchmark where text is not null)) as leaked from documents group by 1")
def leak_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    leaked = C.leaks_exact(docs, table(spark, sf_dir, "benchmark")).groupBy("lang").agg(F.count(F.lit(1)).alias("leaked"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(leaked, "lang", "left").select("lang", "n", F.coalesce("leaked", F.lit(0)).cast("long").alias("leaked"))


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) and b.text <> ''")
def leak_contains(spark, sf_dir):
    return C.leaks_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("select count(distinct doc_id) as leaked from documents d join benchmark b on contains(d.text, b.text) and b.text <> ''")
def leak_flag_count(spark, sf_dir):
    found = C.leaks_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return found.agg(F.count_distinct("doc_id").alias("leaked"))


@query(f"""select lang, count(*) as kept from documents where text is null or {sql_key('text')} not in (
  select {sql_key('text')} from documents join labels using (doc_id) where toxic = 1 and text is not null) group by 1""")
def drop_list_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha1(X.dedup_key(F.col("text"))).alias("key"))
    drop = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return C.without(docs, drop, F.col("key"), F.col("key")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""
with d as (select {sql_key('text')} as k, min(case when toxic = 1 then 'toxic' else 'poor' end) as reason from documents join labels using (doc_id) where toxic = 1 or quality = 0 group by 1)
select doc_id, reason from documents join d on {sql_key('text')} = d.k""")
def hand_drop_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1(X.dedup_key(F.col("text"))).alias("key"))
    reason = F.when(F.col("toxic") == 1, "toxic").otherwise("poor").alias("reason")
    drop = docs.join(table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0"), "doc_id").select("key", reason)
    return C.with_reasons(docs, drop, F.col("key"), F.col("key"), "reason").select("doc_id", "reason")


_OPENS = " or ".join(f"starts_with(trim(regexp_replace(lower(text), '{X.LEAD_PREFIX}', '')), '{o} ')" for o in X.OPENINGS)


@query(f"select role, count(*) as n, count(*) filter (regexp_matches(text, '{X.COLLIDE_WORDS}') or {_OPENS}) as collide from conversations group by 1")
def collides(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.collides(F.col("text"))).alias("collide"))


@query("""select doc_id, len(r) as n_runs, coalesce(list_max(list_transform(r, lambda x: cast(x as int))), -1) as largest from
  (select doc_id, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) <= 6) as r from documents)""")
def digit_runs(spark, sf_dir):
    runs = X.digit_runs(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.coalesce(F.array_max(runs), F.lit(-1)).alias("largest"))


@query("select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, count(distinct json_extract_string(props, '$.k')) as kinds from events group by 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_distinct(k).alias("kinds"))


@query("select n_nationkey, n_name, to_json({k: n_nationkey, name: n_name}) as line from nation")
def json_lines(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("line"))


ALIASES = [("Desk lamp", [4]), ("status_led", [2]), ("porch lights", [5, 6, 7, 8]), ("wall", list(range(9, 18)))]


@query("""
with a(name, pins) as (values ('desk lamp', [4]), ('status led', [2]), ('porch lights', [5,6,7,8]), ('wall', [9,10,11,12,13,14,15,16,17])),
c as (select event_id, case event_id % 3 when 0 then 'set' when 1 then 'seq' else 'alias' end as action, case when user_id % 4 = 0 then [cast(user_id % 20 as int)] else [] end as pins,
  ['desk lamp', 'porch lights', 'nobody', 'status led', 'wall'][1 + event_id % 5] as x, ['wall', 'desk lamp', 'porch lights', 'pump'][1 + user_id % 4] as y from events),
r as (select c.*, p.pins as xp, q.pins as yp from c left join a p on p.name = x left join a q on q.name = y),
s as (select *, case when action = 'alias' then 'execute' when xp is null then 'unknown_name' when len(pins) + len(xp) > 16 then 'too_many_pins'
  when yp is null then 'unknown_name' when len(pins) + len(xp) + len(yp) > 16 then 'too_many_pins' else 'execute' end as v from r)
select event_id, v as verdict, case when v <> 'execute' then '' when action = 'alias' then array_to_string(pins, ',') else array_to_string(list_concat(list_concat(pins, xp), yp), ',') end as resolved from s""")
def alias_resolve(spark, sf_dir):
    aliases = spark.createDataFrame(ALIASES, "name string, pins array<int>")
    one = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), one(["set", "seq", "alias"], F.col("event_id") % 3).alias("action"),
        F.when(F.col("user_id") % 4 == 0, F.array((F.col("user_id") % 20).cast("int"))).otherwise(F.array().cast("array<int>")).alias("pins"),
        F.array(one(["Desk_Lamp", "porch  lights", "nobody", "Status-LED", "wall"], F.col("event_id") % 5), one(["WALL", "desk lamp", "Porch Lights", "pump"], F.col("user_id") % 4)).alias("names"),
    )
    out = A.resolve(rows, aliases)
    return out.select(F.col("id").alias("event_id"), "verdict", F.array_join("resolved", ",").alias("resolved"))


@query(f"""select doc_id % 200 * 250 as ms, array_to_string(list_filter(['every ' || ms || ' ms', 'every ' || ms || ' milliseconds',
  case when ms % 1000 = 0 then 'every ' || ms // 1000 || case when ms = 1000 then ' second' else ' seconds' end end,
  case when ms % 1000 = 500 then 'every ' || ms // 1000 || '.5 seconds' end,
  case when ms % 60000 = 0 then 'every ' || ms // 60000 || case when ms = 60000 then ' minute' else ' minutes' end end,
  case when ms > 0 and 1000 % nullif(ms, 0) = 0 then 'at ' || 1000 // ms || ' Hz' end, case when ms % 1000 = 0 then 'every ' || ms // 1000 || ' s' end,
  case when ms > 0 and 1000 % nullif(ms, 0) = 0 and ms < 1000 then 1000 // ms || ' times a second' end,
  case ms when 100 then 'very fast' when 250 then 'fast' when 500 then 'twice a second' when 1000 then 'once a second' when 2000 then 'slowly' end], lambda x: x is not null), '|') as forms, count(*) as n
from (select doc_id, doc_id % 200 * 250 as ms from documents) as documents group by all""")
def interval_words(spark, sf_dir):
    ms = (F.col("doc_id") % 200 * 250).alias("ms")
    rows = table(spark, sf_dir, "documents").select(ms)
    return rows.select("ms", F.array_join(X.interval_words(F.col("ms")), "|").alias("forms")).groupBy("ms", "forms").agg(F.count(F.lit(1)).alias("n"))


@query("""select k, array_to_string(case k when 0 then ['', 'forever', 'without end'] when 1 then ['once', 'one time'] when 2 then ['twice', 'two times']
  when 3 then ['three times', 'thrice'] else [k || ' times', 'for ' || k || ' cycles', k || 'x'] end, '|') as forms from (select distinct doc_id % 12 as k from documents)""")
def count_words(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 12).alias("k")).distinct()
    return rows.select("k", F.array_join(X.count_words(F.col("k")), "|").alias("forms"))


@query("""
with b as (select conv_id, turn, case when conv_id % 4 = 0 then lower(text) else text end as text from conversations)
select count(*) as lines, count(*) filter (a.text is distinct from b.text) as differ, round(100 * count(*) filter (a.text is not distinct from b.text) / count(*), 9) as same_percent
from conversations a full join b on a.conv_id = b.conv_id and a.turn = b.turn""")
def positional_diff(spark, sf_dir):
    a = table(spark, sf_dir, "conversations")
    b = a.withColumn("text", F.when(F.col("conv_id") % 4 == 0, F.lower("text")).otherwise(F.col("text")))
    out = E.line_diff(a, b, ["conv_id", "turn"], "text")
    return rounded(out.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("same")).alias("differ"), (100 * F.count_if("same") / F.count(F.lit(1))).alias("same_percent")), "same_percent")


@query("select doc_id, lang from documents qualify row_number() over (partition by lang order by sha1('q' || doc_id), doc_id) <= 40")
def quota_fill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.quota(docs, "lang", 40, F.concat(F.lit("q"), F.col("doc_id").cast("string")), "doc_id")


@query("select doc_id, row_number() over (order by sha1('s' || doc_id), doc_id) <= (select cast(floor(count(*) * 0.02e0) as bigint) from documents) as is_val from documents")
def ordinal_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return C.ordinal_split(docs, F.concat(F.lit("s"), F.col("doc_id").cast("string")), "doc_id", 0.02)


@query(f"""
with u as (select 0 as prio, conv_id * 1000 + turn as id, text from conversations where role = 'user' union all select 1, conv_id * 1000 + turn, text from conversations where role <> 'user'
  union all select 2, item_id, text from benchmark)
select prio, count(*) as n from (select * from u qualify row_number() over (partition by {sql_key('text')} order by prio, id) = 1) group by 1""")
def union_precedence(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    out = C.precedence_union([turns.where("role = 'user'").drop("role"), turns.where("role <> 'user'").drop("role"), items], "text", "id")
    return out.groupBy("prio").agg(F.count(F.lit(1)).alias("n"))


@query("""
with a as (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings),
d as (select a.vec_id, abs(cast(a.x as double) - cast(b.x as double)) as d from a join a b on b.vec_id = a.vec_id + 1 and a.i = b.i)
select vec_id, round(max(d), 6) as max_abs, round(sqrt(avg(d * d)), 6) as rms from d group by 1""")
def vec_max_rms_diff(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    d = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    total = F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x)
    out = pairs.select("vec_id", d.alias("d"))
    return out.select("vec_id", F.round(F.array_max("d"), 6).alias("max_abs"), F.round(F.sqrt(total / F.size("d")), 6).alias("rms"))


@query("select substr(sha256(string_agg(n_nationkey || '=' || n_name, chr(10) order by n_nationkey)), 1, 16) as fingerprint from nation")
def fingerprint(spark, sf_dir):
    return E.fingerprint(table(spark, sf_dir, "nation"), F.concat_ws("=", "n_nationkey", "n_name"), "n_nationkey")


@query(f"select p_partkey, {sql_collapse("translate(lower(p_name), '_-', '  ')")} as norm, {sql_collapse("translate(lower(p_brand || '_' || p_name), '_-', '  ')")} as alias from part")
def fold_name_norm(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", X.name_norm(F.col("p_name")).alias("norm"), X.alias_norm(F.concat_ws("_", "p_brand", "p_name")).alias("alias"))


_D = "[" + ", ".join("'" + _q(w) + "'" for w in X.DANGLING) + "]"


@query(f"""
with w as (select conv_id, turn, regexp_split_to_array(trim(regexp_replace(text, '[?.!,]+$', '')), '\\s+') as w from conversations),
c as (select *, list_filter(range(1, greatest(1, len(w) - 1) + 1), lambda i: i < len(w) and list_contains({_D}, regexp_replace(lower(w[i]), '^,+|,+$', '', 'g'))) as cuts from w)
select conv_id, turn, case when len(cuts) > 0 then array_to_string(w[1 : cuts[1 + {sql_draw("conv_id || '-' || turn", 1 << 40)} % greatest(1, len(cuts))]], ' ') end as cut from c""")
def truncate_dangling(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", X.truncate(F.col("text"), F.concat_ws("-", "conv_id", "turn")).alias("cut"))


def sql_list(options: list[str]) -> str:
    return "[" + ", ".join("'" + _q(w) + "'" for w in options) + "]"


def sql_case(s: str, key: str, question: float) -> str:
    """X.case_and_punctuate; s and key are columns."""
    c, q, p = (sql_draw(f"'{x}' || {key}", 1000) for x in ("case", "question", "point"))
    up = lambda x: f"replace(upper({x}), 'ẞ', 'SS')"  # noqa: E731  (DuckDB has one letter for it, Java two)
    cased = f"case when {c} < 300 then {up(f'substr({s}, 1, 1)')} || substr({s}, 2) when {c} < 340 then {up(s)} else {s} end"
    return f"({cased}) || case when {q} < {int(question * 1000)} then '?' when {p} < 90 then '.' when {p} < 180 then '!' else '' end"


def sql_dressed(s: str, key: str, prefixes: list[str], suffixes: list[str]) -> str:
    head, tail = (f"{sql_list(o)}[1 + {sql_draw(f"'{x}' || {key}", len(o))}]" for x, o in (("head", prefixes), ("tail", suffixes)))
    return sql_collapse(f"{head} || {s} || {tail}")


_BARE = "regexp_replace(lower(substr(text, 1, 1)) || substr(text, 2), '[?.!]+$', '')"


@query(f"""with k as (select item_id, cast(item_id as varchar) as key, text from benchmark), d as (select item_id, key, {sql_dressed(_BARE, "key", X.VARY_PREFIX, X.VARY_SUFFIX)} as d from k)
  select item_id, {sql_case("d", "key", 0.10)} as dressed from d""")
def vary_decorate(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.vary(F.col("text"), F.col("item_id").cast("string")).alias("dressed"))


@query(f"""
with b as (select item_id, text, item_id % 2 as half from benchmark), s as (select half, count(*) as n from b group by 1),
r as (select item_id, text, b.half, cast(unnest(range(cast(ceil(1000 / n) as bigint))) as int) as turn from b join s on s.half = b.half),
k as (select *, item_id || '#' || turn as key from r), d as (select *, {sql_dressed(_BARE, "key", X.VARY_PREFIX, X.VARY_SUFFIX)} as d from k)
select item_id, case when turn = 0 then text else {sql_case("d", "key", 0.10)} end as text, half, turn from d
qualify row_number() over (partition by half order by turn, sha1(cast(item_id as varchar)), item_id) <= 1000""")
def quota_top_up(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").withColumn("half", F.col("item_id") % 2)
    return C.top_up(items, "half", 1000, F.col("item_id").cast("string"), "item_id", "text")


@query("""
with t as (select doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), lambda w: ascii(w) % 1000 + 2) as p, [2 + doc_id % 7, 18] as q from documents),
c as (select doc_id, p, q, unnest(range(greatest(1, cast(ceil(len(p) / 61.0) as bigint)))) as part from t),
f as (select doc_id, part, p[part * 61 + 1 : part * 61 + 61] as p, q from c), g as (select doc_id, part, list_concat(list_concat(p, [1]), q) as s, len(q) as masked from f)
select doc_id, cast(part as int) as part, array_to_string(list_concat(s, list_transform(range(64 - len(s)), lambda i: 0)), ',') as tokens, cast(masked as bigint) as masked from g""")
def pack_sequences(spark, sf_dir):
    """Whole texts, a number a word, in as many sequences of 64 as they need."""
    out = packed_words(spark, sf_dir)
    return out.select("doc_id", "part", F.array_join("tokens", ",").alias("tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("masked"))


def packed_words(spark, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda w: (F.ascii(w) % 1000 + 2).cast("int")).alias("p"), F.array((2 + F.col("doc_id") % 7).cast("int"), F.lit(18)).alias("c"))
    return P.pack(P.in_parts(rows, "p", "c", 64), "p", "c", 64)


PACK_WIDTH = 96  # of the model's sequences


@query(None)
def pack_whole_texts(spark, sf_dir):
    """The byte-pair ids of whole texts: a text that does not fit one sequence goes on in the next, so no id is lost."""
    import public_tokenizers

    ids = F.coalesce(B.encode(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")), F.array().cast("array<int>"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.transform(ids, lambda i: i + len(P.RESERVED)).alias("p"), F.array((2 + F.col("doc_id") % 7).cast("int"), F.lit(18)).alias("c")
    )
    out = P.pack(P.in_parts(rows, "p", "c", PACK_WIDTH), "p", "c", PACK_WIDTH)
    return out.select("doc_id", "part", F.array_join("tokens", ",").alias("tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("masked"))


@query("select count(*) filter (n <= 400) as kept, count(*) filter (n > 400) as dropped, max(n) as longest from (select len(string_split(text, ' ')) + 3 as n from documents)")
def over_length(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.split("text", " ", -1).alias("p"), F.array(F.lit(1), F.lit(2)).alias("c"))
    out = P.overlong(rows, "p", "c", 400)
    return out.select("kept", "dropped", F.col("longest").cast("long").alias("longest"))


@query("select doc_id, array_to_string(case when len(w) > 12 then w[-12:] else w end, ' ') as ending from (select doc_id, string_split(text, ' ') as w from documents)")
def suffix_window(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.last_tokens(F.split("text", " ", -1), 12), " ").alias("ending"))


@query("""select o_orderpriority, round(sum(o_totalprice * (o_orderkey % 3)) / greatest(1.0, sum(o_orderkey % 3)), 4) as masked_mean from orders group by 1""")
def masked_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("w", F.col("o_orderkey") % 3)
    return E.masked_mean(rows, "o_totalprice", "w", "o_orderpriority").withColumn("masked_mean", F.round("masked_mean", 4))


@query("""select s as step, round(case when s < 20 then 0.003e0 * (s + 1) / 20e0 else 0.0003e0 + 0.5e0 * 0.0027e0 * (1 + cos(pi() * least(1.0, (s - 20) / 180e0))) end, 9) as lr
  from (select distinct event_id % 220 as s from events)""")
def lr_schedule(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select((F.col("event_id") % 220).alias("step")).distinct()
    return steps.select("step", F.round(E.learning_rate(F.col("step"), 0.003, 20, 200, 0.0003), 9).alias("lr"))


@query("""select user_id, event_id, round(min(value) over (partition by user_id order by event_id rows unbounded preceding), 9) as best from events""")
def running_best(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "events")
    best = F.min("value").over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("user_id", "event_id", F.round(best, 9).alias("best"))


@query("select count(*) as n, list_sort(list(n_nationkey)) = range(0, count(*)) as contiguous from nation")
def contiguous_ids(spark, sf_dir):
    return O.contiguous(table(spark, sf_dir, "nation"), "n_nationkey")


@query(None)
def bpe_encode(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("ids", B.encode(F.col("text"), path))
    return rows.select("doc_id", F.size("ids").alias("n_ids"), (B.decode(F.col("ids"), path).cast("string") == F.col("text")).alias("same"))


@query(None)
def generated_frames(spark, sf_dir):
    rows = N.with_frames(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")))
    f = F.col("frame")
    return rows.groupBy(f["action"].alias("action"), G.range_verdict(f).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~G.well_shaped(f)).alias("misshapen"))


def sql_key_of(slot: str, seed: int = 1) -> str:
    return f"'{seed}|' || doc_id || '|{_q(slot)}'"


@query(f"select doc_id, {V.NAME.sql(sql_key_of('name'))} as name, {V.GROUP_NAME.sql(sql_key_of('group'))} as group_name from documents")
def generated_names(spark, sf_dir):
    d = N.Draws(1, "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", N.name(d, "name").alias("name"), N.group_name(d, "group").alias("group_name"))


_SAID = " ".join(f"when '{k}' then {bank.sql(sql_key_of(k))}" for k, (bank, _) in V.REFUSALS.items())
_MOOD = " ".join(f"when '{k}' then '{mood}'" for k, (_, mood) in V.REFUSALS.items())
_DRESSED = " ".join(f"when '{m}' then {sql_dressed('said', 'key', p, s)}" for m, (p, s, _) in V.MOODS.items())
_CASED = " ".join(f"when '{m}' then {sql_case('dressed', 'key', q)}" for m, (_, _, q) in V.MOODS.items())


@query(f"""with g as (select doc_id, {sql_choice(V.KINDS, sql_key_of('generator'))} as generator from documents),
  s as (select doc_id, generator, case generator {_SAID} end as said, case generator {_MOOD} end as mood, {sql_key_of('dress')} as key from g),
  d as (select doc_id, generator, mood, key, case mood {_DRESSED} end as dressed from s)
  select doc_id, generator, case mood {_CASED} end as text from d""")
def generated_refusals(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return N.negatives(ids).select(F.col("id").alias("doc_id"), "generator", "text")


@query(None)
def generated_corpus(spark, sf_dir):
    """A corpus as large as documents; what users say in conversations is the pool of utterances far from commands."""
    pools = {"far": table(spark, sf_dir, "conversations").where("role = 'user'").select("text")}
    return N.corpus(spark, table(spark, sf_dir, "documents").count(), pools=pools)


from loomery.plans import surface  # noqa: E402, F401  (further queries, in the same tables)
