"""Further queries of the catalogue: filters, reports, rates of runs, numbers of a decoder, and the device."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomery.functions import grammar as G
from loomery.functions import text as X
from loomery.functions.banks import SCALE, sql_choice
from loomery.functions.templates import HEADS
from loomery.operators import curate as C
from loomery.operators import evaluate as E
from loomery.operators import alias as A
from loomery.operators import bytepairs as B
from loomery.operators import generate as N
from loomery.operators import history as H
from loomery.operators import ordinals as O
from loomery.operators import pack as P
from loomery.operators import vocabulary as V
from loomery.plans.catalogue import _CASED, _DRESSED, ORACLE_SQL, SQL_JUDGED, SQL_PARSED, WILSON, _SCORE, commands, judged, packed_words, query, rounded, sql_case, sql_draw, sql_key, sql_list
from loomery.sources import formats as F_
from loomery.sources import tables as S
from loomery.sources.scratch import shared_root
from loomery.sources.tables import table
from loomery.streaming.aliases import alias_stream
from loomery.streaming.device import device_replay

METRICS = {
    "exact": ("pos_ok", "pos_n"), "false_accept": ("false_accepts", "neg_n"), "loose_accept": ("loose_accepts", "neg_n"), "pin_copy": ("pin_ok", "pin_n"),
    "substitution": ("sub_hit", "sub_n"), "danger": ("pos_danger", "pos_n"),
}


@query("select event_type, count(*) as n from events where event_type in ('view', 'click', 'purchase') and event_type not like 'pur%' group by 1")
def intent_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return S.by_intent(events, ["view", "click", "purchase"], "pur", intent="event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select lang, count(*) filter (regexp_matches(trim(text), '.') and not regexp_matches(text, '[\\n\\r\\t]')) as clean, count(*) as n from documents group by 1")
def clean_line_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    kept = C.clean_lines(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("clean"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(kept, "lang", "left").select("lang", F.coalesce("clean", F.lit(0)).cast("long").alias("clean"), "n")


@query("""
with b as (select doc_id, 'no ' || lang || ' in ' || doc_id as said from documents where not coalesce(contains(lower(text), lang), false))
select (select count(*) from b) as bad, (select string_agg(said, '|' order by doc_id) from (select * from b order by doc_id limit 5)) as messages""")
def span_quarantine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    message = F.concat(F.lit("no "), "lang", F.lit(" in "), F.col("doc_id").cast("string"))
    _, report = C.quarantine(docs, F.contains(F.lower("text"), F.col("lang")), message, "doc_id")
    return report.select("bad", F.array_join("messages", "|").alias("messages"))


@query("select doc_id, lang from documents order by doc_id limit 25")
def head_limit(spark, sf_dir):
    return S.first_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 25)


@query("""
with o as (select w, row_number() over (order by length(w) desc, w) as place from (values """ + ", ".join(f"('{o}')" for o in sorted(X.OPENINGS)) + """) t(w)),
t as (select trim(regexp_replace(lower(text), '""" + X.LEAD_PREFIX + """', '')) as body from conversations)
select w as opening, place, count(body) as n from o left join t on starts_with(body, w || ' ') group by all""")
def openings_longest_first(spark, sf_dir):
    """The openings of commands, the longest first, and how many turns open with each."""
    openings = spark.createDataFrame([(o, i) for i, o in enumerate(X.OPENINGS, 1)], "opening string, place long")
    body = F.trim(F.regexp_replace(F.lower("text"), X.LEAD_PREFIX, ""))
    opened = F.filter(X.listed(X.OPENINGS), lambda o: F.startswith(body, F.concat(o, F.lit(" "))))
    counts = table(spark, sf_dir, "conversations").select(F.explode(opened).alias("opening")).groupBy("opening").agg(F.count(F.lit(1)).alias("n"))
    return openings.join(counts, "opening", "left").select("opening", "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("select p_partkey, p_size * 65536 + p_partkey % 65536 as packed, row_number() over (order by p_size * 65536 + p_partkey % 65536, p_partkey) as place from part")
def packed_pairs(spark, sf_dir):
    """Pairs packed in one number and sorted by it, as a merge table has them."""
    packed = (F.shiftleft(F.col("p_size").cast("long"), 16) + F.col("p_partkey") % 65536).alias("packed")
    return O.with_ordinal(table(spark, sf_dir, "part").select("p_partkey", packed), "packed", "p_partkey")


@query("select doc_id, row_number() over (order by sha1('7|' || doc_id), doc_id) as place from documents")
def seeded_shuffle(spark, sf_dir):
    return O.shuffled(table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")


@query("select conv_id, turn, row_number() over (order by conv_id, turn) as line from conversations")
def line_numbers(spark, sf_dir):
    return O.with_ordinal(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", out="line")


def sql_merkle(source: str, line: str, order: str, fanout: int, levels: int = 7) -> str:
    """O.merkle_root over a table of fewer than fanout ** levels rows."""
    steps = [f"l0 as (select row_number() over (order by {order}, sha256('=' || {line})) - 1 as i, sha256('=' || {line}) as d from {source})"]
    for k in range(1, levels + 1):
        steps.append(f"l{k} as (select i // {fanout} as i, sha256(string_agg(d, '' order by i)) as d from l{k - 1} group by i // {fanout})")
    tops = " union all ".join(f"select {k} as depth, d from l{k} where (select count(*) from l{k}) = 1" for k in range(1, levels + 1))
    return f"with {', '.join(steps)} select (select count(*) from l0) as n, cast(depth as int) as depth, d as root from ({tops}) order by depth limit 1"


@query(sql_merkle("documents", "concat_ws('|', doc_id, lang, text)", "doc_id", 16))
def merkle_documents(spark, sf_dir):
    """A digest of documents in the order of their ids, by whole texts."""
    return O.merkle_root(table(spark, sf_dir, "documents"), F.concat_ws("|", "doc_id", "lang", "text"), "doc_id", fanout=16)


@query(sql_merkle("lineitem", "concat_ws('|', l_orderkey, l_linenumber, l_quantity::int)", "l_orderkey, l_linenumber", O.FANOUT))
def merkle_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return O.merkle_root(rows, F.concat_ws("|", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int")), "l_orderkey", "l_linenumber")


@query("select count(*) as n, count(distinct o_orderkey) = count(*) and min(o_orderkey) = 0 and max(o_orderkey) = count(*) - 1 as contiguous from orders")
def contiguous_orders(spark, sf_dir):
    return O.contiguous(table(spark, sf_dir, "orders"), "o_orderkey")


_PIECES = r"""regexp_extract_all(regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g'), '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+')"""


@query(f"select doc_id, len(w) as n_words, sha256(array_to_string(w, chr(31))) as words_sha256 from (select doc_id, {_PIECES} as w from documents where text is not null)")
def bpe_words(spark, sf_dir):
    """What a byte-level tokenizer splits whole texts into."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", B.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join("w", "\x1f"), 256).alias("words_sha256"))


@query("""
with b as (select cast('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')) as int) as byte from benchmark),
s as (select i as byte, case when p then i else 256 + cast(sum(cast(not p as int)) over (order by i) as int) - 1 end as code
  from (select cast(i as int) as i, (i between 33 and 126 or i between 161 and 172 or i between 174 and 255) as p from (select unnest(range(256)) as i)))
select byte, code, count(*) as n from b join s using (byte) group by all""")
def byte_symbols(spark, sf_dir):
    """The bytes of the benchmark's texts, the characters that stand for them in byte-pair files, and how often each is there."""
    pairs = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))
    rows = table(spark, sf_dir, "benchmark").select(F.explode(pairs).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    byte = F.conv("x", 16, 10).cast("int")
    return rows.select(byte.alias("byte"), P.byte_symbols(byte).alias("code"), "n")


@query("select vec_id, list_position(embedding, list_max(embedding)) - 1 as top from embeddings")
def top_element(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", E.top1(F.col("embedding")).alias("top"))


@query("""
with v as (select vec_id, unnest(embedding) as x from embeddings), m as (select vec_id, max(x) as m from v group by 1)
select vec_id, round(-ln(sum(exp(cast(x as double) - m))), 6) as confidence from v join m using (vec_id) group by vec_id, m""")
def mean_log_prob(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("steps"))
    return v.select("vec_id", F.round(E.mean_log_prob(F.col("steps")), 6).alias("confidence"))


_RATES = " union all ".join(f"select event_type, run, '{m}' as metric, {k} as hits, {n} as n from r" for m, (k, n) in METRICS.items())


@query(f"""
with {SQL_JUDGED}, r as (select event_type, user_id % 5 as run, {_SCORE} from j group by all), u as ({_RATES}),
s as (select event_type, metric, count(*) as n_runs, avg(hits / greatest(1, n)) as mean_rate, case when count(*) > 1 then (max(hits / greatest(1, n)) - min(hits / greatest(1, n))) / 2 end as half_range, max(n) as n from u group by all),
s2 as (select *, cast(round_even(mean_rate * n, 0) as bigint) as hits from s), i as (select *, hits / nullif(n, 0) as p from s2)
select event_type, metric, n_runs, round(mean_rate, 9) as mean_rate, round(half_range, 9) as half_range, hits, n as cases, round(rate, 9) as rate, round(low, 9) as low, round(high, 9) as high
from (select *, {WILSON} from i)""")
def metric_sweep(spark, sf_dir):
    runs = E.score(judged(spark, sf_dir).withColumn("run", F.col("user_id") % 5), "event_type", "run")
    return rounded(E.sweep(runs, "run", "event_type", METRICS), "mean_rate", "half_range", "rate", "low", "high")


_MESSAGE = f"""case verdict when 'bad_pin' then 'pin ' || list_filter(pins, lambda x: not list_contains({G.PINS_S3}, x))[1] || ' is not on this board'
  when 'too_many_pins' then 'a chase has 6 pins at most, not ' || n when 'bad_interval' then ms || ' ms is not within 50 to 10000 ms' else '' end"""


@query(f"with {SQL_PARSED} select event_id, {_MESSAGE} as message from v where ok")
def range_messages(spark, sf_dir):
    return commands(spark, sf_dir).where("frame is not null").select("event_id", G.range_message(F.col("frame")).alias("message"))


_STRICT = "not (act in ('blink', 'seq') and lvl is not null) and n - names <= 16 and names <= 4"


@query(f"""with {SQL_PARSED} select event_id, {_STRICT} as fits, case when cmd = '<unknown> <end>' then 'unknown' when verdict = 'too_many_pins' and len(pins) <= 6 then 'execute' else verdict end as verdict from v where ok""")
def device_rules(spark, sf_dir):
    f = F.col("frame")
    return commands(spark, sf_dir).where("frame is not null").select("event_id", G.well_shaped(f, strict_device=True).alias("fits"), G.device_verdict(f).alias("verdict"))


@query(f"""with {SQL_PARSED} select event_id, concat_ws(' ', case when act = '' then 'unknown' else act end, case when every then 'all' end,
  nullif(array_to_string(list_transform(pins, lambda x: 'pin' || x), ' '), ''), case when names > 0 then '"' || regexp_extract(tg, '<name> ([^<>]*) <nend>', 1) || '"' end, lvl, ms || 'ms', 'x' || cnt) as line from v where ok""")
def describe_commands(spark, sf_dir):
    return commands(spark, sf_dir).where("frame is not null").select("event_id", G.describe(F.col("frame")).alias("line"))


_LOCKED = f"{sql_draw('cast(event_id as varchar)', 10)} = 3"


@query(f"""with {SQL_JUDGED}, hv as (select 'all' as half, * from j union all select 'open', * from j where not {_LOCKED}), s as (select half, {_SCORE} from hv group by half),
  l as (select half, bool_or({_LOCKED}) as locked from hv group by half)
select half, 'score' as section, label, cast(value as varchar) as value from (unpivot s on columns(* exclude half) into name label value value)
union all select half, 'outcome', outcome, cast(count(*) as varchar) from hv join l using (half) where not l.locked group by half, outcome""")
def report_lines(spark, sf_dir):
    """Two reports: of all rows, a tenth of which is locked, so that no details are shown, and of the rest, with them."""
    every = judged(spark, sf_dir).withColumn("locked", X.draw(F.col("event_id").cast("string"), 10) == 3)
    out = None
    for half, rows in (("all", every), ("open", every.where("not locked"))):
        details = rows.groupBy(F.col("outcome").alias("label")).agg(F.count(F.lit(1)).alias("value"))
        part = E.report(E.score(rows), {"outcome": details}, rows).select(F.lit(half).alias("half"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"select conv_id, turn, {sql_case('text', "conv_id || '-' || turn", 0.05)} as dressed from conversations where text is not null")
def case_and_punctuate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", X.case_and_punctuate(F.col("text"), F.concat_ws("-", "conv_id", "turn")).alias("dressed"))


@query("""
with w as (select item_id, text, string_split(text, ' ') as w from benchmark where text is not null and text <> ''),
t as (select item_id, text, w, unnest(range(1, len(w) + 1)) as i from w),
s as (select item_id, text, w, i, length(array_to_string(w[1 : i - 1], ' ')) + case when i > 1 then 1 else 0 end as s, length(w[i]) as n from t),
p as (select *, strpos(lower(text), lower(w[1 + len(w) // 2])) - 1 as lo, length(w[1 + len(w) // 2]) as size from s)
select item_id, string_agg(cast(i as varchar), ',' order by i) filter (s + n > lo and s < lo + size) as ids from p group by item_id""")
def name_span_ids(spark, sf_dir):
    """The words, as tokens with offsets, that overlap the first place of an item's middle word in any case."""
    words = F.split("text", " ", -1)
    ends = F.aggregate("w", F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.length(x) + F.coalesce(F.try_element_at(acc, F.lit(-1)) + 1, F.lit(0)))))
    rows = table(spark, sf_dir, "benchmark").where("text is not null and text <> ''").select("item_id", "text", words.alias("w"))
    rows = rows.withColumn("ends", ends)
    tokens = F.zip_with("w", F.transform("ends", lambda e, i: F.struct(e.alias("e"), (i + 1).alias("id"))), lambda w, e: F.struct(e["id"].alias("id"), (e["e"] - F.length(w)).alias("s"), e["e"].alias("e")))
    middle = F.get("w", F.floor(F.size("w") / 2).cast("int"))
    return rows.select("item_id", F.array_join(X.span_tokens(F.col("text"), middle, tokens), ",").alias("ids"))


@query(f"select doc_id, {sql_key('text')} = '' as blank, array_to_string([cast(ascii(lang) % 7 + 2 as int), 9, 4, 2, 18], ',') as ids from documents")
def completion_ids(spark, sf_dir):
    """A label's ids: an action, a pin mark, two digits (ids 0 to 9 here) and the end."""
    docs = table(spark, sf_dir, "documents")
    action = F.element_at(F.array(*map(F.lit, P.RESERVED)), (F.ascii("lang") % 7 + 3).cast("int"))
    symbols = F.array(action, F.lit("<pin>"), F.lit("4"), F.lit("2"), F.lit("<end>"))
    ids = P.completion_ids(symbols, list(range(10)), F.array().cast("array<int>"))
    return docs.select("doc_id", (X.dedup_key(F.col("text")) == "").alias("blank"), F.array_join(ids, ",").alias("ids"))


@query(None)
def device_events(spark, sf_dir):
    """Every event's command carried out by its user's board, in order; the state machine is beyond SQL and has golden cases."""
    f = F.col("frame")
    rows = commands(spark, sf_dir).where("frame is not null").select(
        F.col("user_id").cast("long").alias("device"), F.col("event_id").cast("long").alias("event_id"), f["action"].alias("action"), G.pins_of(f).alias("pins"), G.names_of(f).alias("names"),
        F.exists(f["targets"], lambda t: t["kind"] == "all").alias("every"), f["level"].alias("level"), f["interval_ms"].alias("interval_ms"), f["count"].alias("rounds"),
    )
    return device_replay(rows)


# Names given, forgotten and looked up by users: five names a device, so that its bound of 16 is never met.
_ALIAS_OPS, _ALIAS_NAMES = ["define", "look", "define", "forget"], ["Desk Lamp", "porch", "Status-LED", "pump", "wall_lights"]


@query(f"""
with c as (select user_id as device, event_id, {sql_list(_ALIAS_OPS)}[1 + event_id % 4] as op, {sql_list(_ALIAS_NAMES)}[1 + event_id // 4 % 5] as name, [cast(event_id % 20 as int), cast(user_id % 7 as int)] as pins from events),
b as (select *, coalesce(last_value(case op when 'define' then 1 when 'forget' then 0 end ignore nulls) over w, 0) as live,
    last_value(case when op = 'define' then pins end ignore nulls) over w as last_pins
  from c window w as (partition by device, name order by event_id rows between unbounded preceding and 1 preceding))
select event_id, op, name, op = 'define' or live = 1 as ok,
  cast(sum(case when op = 'define' and live = 0 then 1 when op = 'forget' and live = 1 then -1 else 0 end) over (partition by device order by event_id) as int) as n_aliases,
  case when op = 'define' then array_to_string(pins, ',') when op = 'look' and live = 1 then array_to_string(last_pins, ',') else '' end as pins from b""")
def alias_state_stream(spark, sf_dir):
    one = lambda words, n: F.element_at(X.listed(words), (n + 1).cast("int"))
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("device"), e.cast("long").alias("event_id"), one(_ALIAS_OPS, e % 4).alias("op"),
        one(_ALIAS_NAMES, F.floor(e / 4) % 5).alias("name"), F.array((e % 20).cast("int"), (F.col("user_id") % 7).cast("int")).alias("pins"),
    )
    return alias_stream(rows).select("event_id", "op", "name", "ok", "n_aliases", F.array_join("pins", ",").alias("pins"))


# Names that a line of symbols cannot hold: with marks, with blanks at their ends, like symbols, blank, or too long.
_ODD_NAMES = ["Desk <1> lamp", " led ", "<pin", "a>b", "", "   ", "<pin>", "n" * 49, "m" * 48, "<<>>", "plain"]


@query(f"""
with e as (select event_id, event_id % 6 as kind, {sql_list(_ODD_NAMES)}[1 + user_id % {len(_ODD_NAMES)}] as name, event_id % 60 as pin, event_id % 900 as ms from events),
f as (select *, trim(name) <> '' and length(name) <= 48 and name <> '<pin>' and kind < 4 as ok from e)
select event_id, ok as parsed, case when ok then ['alias', 'set', 'blink', 'seq'][1 + kind] end as action, case when ok then case when kind = 0 then cast(pin as varchar) else '' end end as pins,
  case when ok then case when kind = 3 then name || '|other' else name end end as names, case when ok and kind = 1 then 'toggle' end as level,
  case when ok and kind = 2 then cast(ms as int) end as interval_ms, case when ok and kind = 2 then 0 end as rounds from f""")
def parse_any_names(spark, sf_dir):
    """Arrays of symbols with names that lines cannot hold, some without their end and some with symbols too many."""
    e, kind = F.col("event_id"), F.col("event_id") % 6
    name = F.element_at(X.listed(_ODD_NAMES), (F.col("user_id") % len(_ODD_NAMES) + 1).cast("int"))
    digits = lambda n: F.array_compact(F.split(n.cast("string"), ""))
    one = lambda *s: F.array(*[F.lit(x) for x in s])
    named = F.concat(one("<name>"), F.array(name), one("<nend>"))
    symbols = (
        F.when(kind == 0, F.concat(one("<alias>", "<pin>"), digits(e % 60), named, one("<end>")))
        .when(kind == 1, F.concat(one("<set>"), named, one("<toggle>", "<end>")))
        .when(kind == 2, F.concat(one("<blink>"), named, one("<int>"), digits(e % 900), one("<cnt>", "0", "<end>")))
        .when(kind == 3, F.concat(one("<seq>"), named, one("<name>", "other", "<nend>", "<end>")))
        .when(kind == 4, F.concat(one("<set>", "<name>"), F.array(name), one("<toggle>", "<end>")))
        .otherwise(F.concat(one("<set>"), named, one("<toggle>", "<end>", "<end>")))
    )
    rows = table(spark, sf_dir, "events").select("event_id", G.frame_of(symbols).alias("frame"))
    f = F.col("frame")
    names = F.transform(F.filter(f["targets"], lambda t: t["kind"] == "name"), lambda t: t["s"])
    return rows.select(
        "event_id", f.isNotNull().alias("parsed"), f["action"].alias("action"), F.array_join(G.pins_of(f), ",").alias("pins"), F.array_join(names, "|").alias("names"),
        f["level"].alias("level"), f["interval_ms"].alias("interval_ms"), f["count"].alias("rounds"),
    )


def sql_fold(s: str) -> str:
    """text.name_fold for the letters of the documents' languages."""
    return f"trim(regexp_replace(translate(replace(lower({s}), 'ß', 'ss'), '_-', '  '), '\\s+', ' ', 'g'))"


def _word(n: int):
    return F.get(F.split("text", " ", -1), F.lit(n))


@query(f"""
with w as (select doc_id, string_split(text, ' ') as w from documents where text is not null)
select {sql_fold("w[1] || '_' || upper(w[2])")} as name, count(*) as n, min(doc_id) as first from w where len(w) > 1 group by 1""")
def fold_unicode_names(spark, sf_dir):
    """The first two words of documents as names, folded alike whatever their case, beyond ASCII too."""
    rows = table(spark, sf_dir, "documents").select("doc_id", _word(0).alias("a"), _word(1).alias("b")).where("b is not null")
    name = X.name_fold(F.concat_ws("_", "a", F.upper("b")))
    return rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query(f"""
with w as (select doc_id, lang, string_split(text, ' ') as w from documents where text is not null),
a as (select {sql_fold("upper(w[1])")} as name, min(doc_id % 25) as pin from w where lang <> 'en' group by 1),
c as (select doc_id, {sql_fold("w[1]")} as x, {sql_fold("w[2]")} as y from w)
select doc_id, case when p.pin is null or q.pin is null then 'unknown_name' else 'execute' end as verdict,
  case when p.pin is null or q.pin is null then '' else p.pin || ',' || q.pin end as resolved from c left join a p on p.name = x left join a q on q.name = y""")
def resolve_unicode_names(spark, sf_dir):
    """Two words of each document as names of pins, against the words that documents in other languages begin with, in capitals."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", _word(0).alias("a"), _word(1).alias("b"))
    names = rows.where("lang <> 'en'").select(F.upper("a").alias("name"), F.array((F.col("doc_id") % 25).cast("int")).alias("pins"))
    commands = rows.select("doc_id", F.lit("set").alias("action"), F.array().cast("array<int>").alias("pins"), F.array("a", "b").alias("names"))
    out = A.resolve(commands, names, fold=X.name_fold, most=100)
    return out.select("doc_id", "verdict", F.array_join("resolved", ",").alias("resolved"))


@query("""select cast(user_id as varchar) as run, event_id as step, round(value, 9) as val, case when user_id % 2 = 1 then round(value / 2, 9) end as sym_acc,
  round(min(value) over (partition by user_id order by event_id), 9) as best from events""")
def history_best(spark, sf_dir):
    """Users as runs and events as their steps: written as histories of two generations, read again, and the best so far."""
    rows = table(spark, sf_dir, "events")
    path = f"{shared_root(spark)}/loomery/history-{uuid.uuid4().hex}"
    new = rows.where("user_id % 2 = 1").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("val"), (F.col("value") / 2).alias("sym_acc"))
    old = rows.where("user_id % 2 = 0").select(F.col("user_id").alias("run"), F.col("event_id").alias("iter"), F.col("value").cast("string").alias("val_loss"))
    H.write_runs(new, path)
    H.write_runs(old, path)
    out = H.best_so_far(H.read_steps(spark, path))
    return rounded(out.select("run", "step", "val", "sym_acc", "best"), "val", "sym_acc", "best")


@query("""
with b as (select user_id, user_id % 4 as g, min(value) as v from events group by all)
select cast(g as int) as g, count(*) as n_runs, round(avg(v), 9) as mean_best, round(case when count(*) > 1 then (max(v) - min(v)) / 2 end, 9) as half_range from b group by g""")
def history_spread(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("val"))
    out = H.spread_of_best(steps, (F.col("run") % 4).cast("int"), F.lit(1))
    return rounded(out.select(F.col("group").alias("g"), "n_runs", F.col("mean_rate").alias("mean_best"), "half_range"), "mean_best", "half_range")


@query("select doc_id, lang, sha256(text) as text_sha256 from documents")
def lines_there_and_back(spark, sf_dir):
    """Whole documents written as JSON lines by the data source, and read again."""
    F_.register(spark)
    path = f"{shared_root(spark)}/loomery/lines-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    docs.write.format("split_lines").option("split", "train").mode("append").save(path)
    back = spark.read.format("split_lines").schema(docs.schema).option("split", "train").load(path)
    return back.select("doc_id", "lang", F.sha2("text", 256).alias("text_sha256"))


@query(f"""with p as ({ORACLE_SQL["pack_sequences"]}) select masked, count(*) as n,
  cast(sum(list_sum(list_transform(string_split(tokens, ','), lambda x: cast(x as bigint)))) as bigint) as total from p group by 1""")
def matrix_there_and_back(spark, sf_dir):
    """The packed sequences of whole documents as a matrix of 16-bit tokens and 8-bit masks, written and read again."""
    F_.register(spark)
    path = f"{shared_root(spark)}/loomery/matrix-{uuid.uuid4().hex}"
    packed_words(spark, sf_dir).select("tokens", "mask").write.format("token_matrix").option("width", 64).mode("append").save(path)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    rows = spark.read.format("token_matrix").load(path).select(total("mask").alias("masked"), total("tokens").alias("t"))
    return rows.groupBy("masked").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("total"))


@query(f"""
with k as (select distinct {sql_key('text')} as k from documents join labels using (doc_id) where toxic = 1 and text is not null)
select lang, count(*) as n, count(*) filter (k is null) as kept, count(*) filter (k is not null) as dropped from documents left join k on {sql_key('text')} = k.k group by 1""")
def drop_summary(spark, sf_dir):
    """How many rows a drop list leaves and takes, by language, in one pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha1(X.dedup_key(F.col("text"))).alias("key"))
    drop = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return C.drop_summary(docs, drop, F.col("key"), F.col("key"), "lang")


@query("""
with d as (select doc_id, ['<set>', '<read>', '<blink>'][1 + doc_id % 3] as act, doc_id % 2 = 0 as named, doc_id % 50 as pin, coalesce(source, '') as source from documents),
i as (select doc_id, case act when '<set>' then 2 when '<read>' then 3 else 4 end as a, named, list_transform(string_split(cast(pin as varchar), ''), lambda x: cast(x as int) + 100) as digits,
  list_transform(string_split(source, ''), lambda x: ascii(x) + 300) as letters, source from d)
select doc_id, array_to_string(list_concat(list_concat([a], case when named then list_concat(list_concat([11], case when source = '' then [] else letters end), [12]) else list_concat([9], digits) end), [18]), ',') as ids from i""")
def completion_names(spark, sf_dir):
    """Labels with pins of one or two digits, or with a name, whose ids are those of its letters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    one = lambda *s: F.array(*[F.lit(x) for x in s])
    action = F.element_at(X.listed(["<set>", "<read>", "<blink>"]), (F.col("doc_id") % 3 + 1).cast("int"))
    digits = F.array_compact(F.split((F.col("doc_id") % 50).cast("string"), ""))
    target = F.when(F.col("doc_id") % 2 == 0, F.concat(one("<name>"), F.array("source"), one("<nend>"))).otherwise(F.concat(one("<pin>"), digits))
    letters = F.transform(F.filter(F.split("source", ""), lambda x: x != ""), lambda x: F.ascii(x) + 300)
    ids = P.completion_ids(F.concat(F.array(action), target, one("<end>")), list(range(100, 110)), letters)
    return docs.select("doc_id", F.array_join(ids, ",").alias("ids"))


def _shared(spark, label: str) -> str:
    return f"{shared_root(spark)}/loomery/{label}-{uuid.uuid4().hex}"


@query("""
with w as (select unnest(string_split(p_name, ' ')) as word, p_partkey from part), c as (select word, count(*) as n from w group by 1)
select word, case when n % 3 = 0 then null else n end as weight from c where word <> ''""")
def word_list(spark, sf_dir):
    """The words of parts' names and their counts as a list in a text file, with comments and blank lines, and as the table it is read as."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ", -1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("word <> ''")
    line = F.when(F.col("n") % 3 == 0, F.concat(F.lit("  "), "word")).otherwise(F.concat_ws("\t", "word", "n"))
    path = _shared(spark, "words")
    S.write_report(words.select(F.explode(F.array(line, F.lit("# a comment"), F.lit("  ")))), path)
    return S.read_words(spark, path, least=1).select("word", F.col("weight").cast("long").alias("weight"))


@query("""select case role when 'user' then 0 else 1 end as part, conv_id * 1000 + turn as at, role as intent, sha256(coalesce(text, '')) as text_sha256 from conversations
  union all select 2, item_id, 'benchmark', sha256(coalesce(text, '')) from benchmark""")
def external_rows(spark, sf_dir):
    """Three outside sets as one, in the order of the list and of each set."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("label_text"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("label_text"), "text")
    rows = S.read_external([turns.where("label_text = 'user'"), turns.where("label_text <> 'user'"), items])
    return rows.select("ord.part", "ord.at", "intent", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("select 'item ' || item_id || ': ' || length(text) || ' characters' as line, count(*) as n from benchmark where text is not null group by 1")
def review_lines(spark, sf_dir):
    """A report for people as a text file, read again line by line."""
    path = _shared(spark, "review")
    items = table(spark, sf_dir, "benchmark").where("text is not null")
    S.write_report(items.select(F.concat(F.lit("item "), "item_id", F.lit(": "), F.length("text"), F.lit(" characters"))), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with l as (select unnest(string_split(text, chr(10))) as line from conversations where text is not null), s as (select substr(replace(line, chr(13), ''), 1, 255) as line from l)
select sha256(line) as line_sha256, length(line) as size, count(*) as n from s where trim(line) <> '' group by all""")
def streamed_lines(spark, sf_dir):
    """The lines of all turns through the line stream: written to a folder, streamed once, and counted."""
    folder, out, check = (_shared(spark, f"lines-{x}") for x in ("in", "out", "check"))
    table(spark, sf_dir, "conversations").where("text is not null").select(F.concat("text", F.lit("\r"))).write.text(folder)
    query_ = S.stream_lines(spark, folder).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
    query_.awaitTermination()
    lines = spark.read.schema("line string").parquet(out)
    return lines.groupBy(F.sha2("line", 256).alias("line_sha256"), F.length("line").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id, case when doc_id % 2 = 0 then '<set>|<name>|' || lang || '|<nend>|<end>' else '<read>|<pin>|' || doc_id % 10 || '|<end>' end as symbols from documents where lang is not null""")
def symbols_of_ids(spark, sf_dir):
    """Ids as a model gives them, back to symbols: a name's letters become one."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang")
    letters = F.transform(F.filter(F.split("lang", ""), lambda c: c != ""), lambda c: F.ascii(c) + 300)
    one = lambda *ids: F.array(*[F.lit(i) for i in ids])
    number = {s: i for i, s in enumerate(P.RESERVED)}
    digit = F.array((F.col("doc_id") % 10 + 100).cast("int"))
    named = F.concat(one(number["<set>"], number["<name>"]), letters, one(number["<nend>"], number["<end>"]))
    ids = F.when(F.col("doc_id") % 2 == 0, named).otherwise(F.concat(one(number["<read>"], number["<pin>"]), digit, one(number["<end>"])))
    texts = F.expr("map(" + ", ".join(f"{300 + c}, '{chr(c)}'" for c in range(97, 123)) + ")")
    known = dict(enumerate(P.RESERVED)) | {100 + d: str(d) for d in range(10)}
    return docs.select("doc_id", F.array_join(G.symbols_of(ids, known, texts), "|").alias("symbols"))


_PLACES = "case outcome " + " ".join(f"when '{o}' then {i}" for i, o in enumerate(E.OUTCOMES)) + " end"


@query(f"""with {SQL_JUDGED}, oc as (select case when valid then 'valid' else 'refusal' end as half, outcome, count(*) as n from j where outcome <> 'correct' group by all)
select half, outcome, n, cast(row_number() over (partition by half order by {_PLACES}) as int) as place from oc""")
def outcome_lines(spark, sf_dir):
    """The failures of each half in the order they are printed in."""
    return E.failure_lines(E.histogram(judged(spark, sf_dir)))


@query("""select item_id, '<unknown>,<end>' as symbols, 'unknown' as action, case when item_id % 2 = 0 then 'even' end as stratum, item_id % 3 = 0 as in_train,
  'class ' || item_id % 4 as v2_class, item_id % 5 = 0 as v2_deferred, case when text is null then null else item_id % 7 = 0 end as locked from benchmark""")
def refusal_flags(spark, sf_dir):
    """Held-out rows whose label is to refuse, with all their flags."""
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(
        "text", i.cast("string").alias("source"), F.when(i % 2 == 0, "even").alias("stratum"), (i % 3 == 0).alias("in_train"), F.concat(F.lit("class "), i % 4).alias("v2_class"),
        (i % 5 == 0).alias("v2_deferred"), F.when(F.col("text").isNotNull(), i % 7 == 0).alias("locked"),
    )
    out = N.refusal_rows(rows)
    return out.select(F.col("source").cast("long").alias("item_id"), F.array_join("symbols", ",").alias("symbols"), "action", "stratum", "in_train", "v2_class", "v2_deferred", "locked")


def _sql_frames(ids: str, id_col: str, seed: int = 1) -> str:
    """CTEs that end in fr: what with_frames() draws, from the definition of each draw; names as their number."""
    key = lambda slot: f"'{seed}|' || {id_col} || '|{slot}'"
    of = lambda slot, i: f"'{seed}|' || {id_col} || '|m' || {i} || '{slot}'"
    below = lambda slot, n: sql_draw(key(slot), n)
    chance = lambda slot, share: f"{below(slot, SCALE)} < {int(share * SCALE)}"
    between = lambda slot, low, high: f"({below(slot, high - low + 1)} + {low})"
    one_of = lambda slot, options: f"({options}[1 + {below(slot, len(options))}])"
    s, far = N.SHARES, [n for n in range(60) if n not in G.PINS_S3]
    pin = f"""case when {sql_draw(of('legal', 'i'), SCALE)} < {int(s['legal pin'] * SCALE)} then ({G.PINS_S3})[1 + {sql_draw(of('p', 'i'), len(G.PINS_S3))}]
      when {sql_draw(of('k', 'i'), 100)} < 55 then ({N.NEAR_PINS})[1 + {sql_draw(of('n', 'i'), len(N.NEAR_PINS))}] when {sql_draw(of('k', 'i'), 100)} < 80 then ({far})[1 + {sql_draw(of('f', 'i'), len(far))}]
      else 100 + {sql_draw(of('t', 'i'), 100)} end"""
    high = f"case when {below('ik', 100)} < 55 then {one_of('il', N.LONG_MS)} when {below('ik', 100)} < 75 then {one_of('im', N.MINUTES_MS)} else {between('ia', G.INTERVAL_MAX + 1, 200_000)} end"
    odd = f"case when {chance('is', 0.4)} then {between('iw', 1, G.INTERVAL_MIN - 1)} else {high} end"
    fine = f"case when {chance('iq', 0.75)} then {one_of('ir', N.ROUND_MS)} else {between('iu', G.INTERVAL_MIN, G.INTERVAL_MAX)} end"
    return f"""
  d0 as (select {id_col}, {sql_choice(N.ACTION_WEIGHTS, key('action'))} as a, {chance('named', s['named'])} as named, list_transform(range(10), lambda i: {pin}) as numbers,
    case when {chance('long', s['long chase'])} then {between('longer', G.MAX_SEQ_PINS + 1, G.MAX_SEQ_PINS + 4)} else {between('chase', 2, G.MAX_SEQ_PINS)} end as chase,
    {below('roll', 100)} as roll, {below('path', 100)} as path, {G.PINS_S3} as board from {ids}),
  d1 as (select *, list_transform(list_sort(list_transform(board, lambda p: sha1({key('sample')} || p) || lpad(p::varchar, 2, '0')))[1 : chase], lambda x: substr(x, 41)::int) as sampled,
    {below('start', 1 << 30)} % (len(board) - chase + 1) as start, list_filter(numbers, lambda x, i: list_position(numbers, x) = i) as own,
    case when {chance('one', s['one pin named'])} then 1 else {between('given', 2, 4)} end as given,
    (a = 'blink' and roll < 70) or (a = 'seq' and {chance('timed', s['timed chase'])}) as timed, a = 'stop' and {chance('bare', s['bare stop'])} as bare,
    {chance('names', s['names'])} as many_names, {chance('mixed', s['mixed'])} as mixed, {chance('every', s['every'])} and a in ('set', 'blink') as every from d0),
  fr as (select {id_col}, a as action,
    case when a = 'seq' then case when named then [] when path < 50 then board[start + 1 : start + chase] when path < 70 then list_sort(sampled) else numbers[1 : chase] end
      when a = 'alias' then own[1 : given] when bare then [] when named then case when many_names then [] when mixed then numbers[1:1] else [] end
      when every then [] when {chance('several', s['several'])} then numbers[1 : {between('many', 2, G.MAX_SEQ_PINS)}] else numbers[1:1] end as pins,
    case when a = 'seq' then case when not named then 0 when {chance('group', s['group of chase'])} then 1 else {between('chase names', 2, 3)} end
      when a = 'alias' then 1 when bare or not named then 0 when many_names then {between('many names', 2, 3)} else 1 end as names,
    case when a = 'seq' then case when not named then [] when {chance('group', s['group of chase'])} then ['g'] else ['0', '1', '2'][1 : {between('chase names', 2, 3)}] end
      when a = 'alias' then case when len(own[1 : given]) > 1 then ['g'] else ['0'] end when bare or not named then [] when many_names then ['0', '1', '2'][1 : {between('many names', 2, 3)}] else ['0'] end as which,
    a not in ('seq', 'alias') and not bare and named and mixed and not many_names and {chance('turned', 0.5)} as turned, a not in ('seq', 'alias') and not bare and not named and every as every, case when a = 'set' then {sql_choice(N.LEVEL_WEIGHTS, key('level'))} end as level,
    case when timed then case when {chance('io', s['odd interval'])} then {odd} else {fine} end end as interval_ms,
    case when timed then case when {chance('cc', 0.85)} then {one_of('cn', N.COMMON_COUNTS)} else {between('cu', 1, 99)} end when a = 'blink' and roll < 84 then {between('blinks', 1, 20)} end as rounds
    from d1)"""


@query(f"""with {_sql_frames('events', 'event_id')} select event_id, action, array_to_string(pins, ',') as pins, cast(names as int) as names, every, level,
  cast(interval_ms as int) as interval_ms, cast(rounds as int) as rounds from fr""")
def generated_frame_rows(spark, sf_dir):
    """A frame for each event, slot by slot."""
    f = F.col("frame")
    rows = N.with_frames(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")))
    return rows.select(
        F.col("id").alias("event_id"), f["action"].alias("action"), F.array_join(G.pins_of(f), ",").alias("pins"), F.size(F.filter(f["targets"], lambda t: t["kind"] == "name")).alias("names"),
        F.exists(f["targets"], lambda t: t["kind"] == "all").alias("every"), f["level"].alias("level"), f["interval_ms"].alias("interval_ms"), f["count"].alias("rounds"),
    )


ORACLE_SQL["generated_frames"] = f"""with {_sql_frames('events', 'event_id')},
  v as (select action, case when len(list_filter(pins, lambda x: not list_contains({G.PINS_S3}, x))) > 0 then 'bad_pin' when action = 'seq' and len(pins) + names > {G.MAX_SEQ_PINS} then 'too_many_pins'
    when interval_ms is not null and interval_ms not between {G.INTERVAL_MIN} and {G.INTERVAL_MAX} then 'bad_interval' else 'execute' end as verdict from fr)
  select action, verdict, count(*) as n, 0::bigint as misshapen from v group by all"""


_FORMS = """list_filter(['every ' || ms || ' ms', 'every ' || ms || ' milliseconds', case when ms % 1000 = 0 then 'every ' || ms // 1000 || case when ms = 1000 then ' second' else ' seconds' end end,
  case when ms % 1000 = 500 then 'every ' || ms // 1000 || '.5 seconds' end, case when ms % 60000 = 0 then 'every ' || ms // 60000 || case when ms = 60000 then ' minute' else ' minutes' end end,
  case when ms > 0 and 1000 % nullif(ms, 0) = 0 then 'at ' || 1000 // ms || ' Hz' end, case when ms % 1000 = 0 then 'every ' || ms // 1000 || ' s' end,
  case when ms > 0 and 1000 % nullif(ms, 0) = 0 and ms < 1000 then 1000 // ms || ' times a second' end,
  case ms when 100 then 'very fast' when 250 then 'fast' when 500 then 'twice a second' when 1000 then 'once a second' when 2000 then 'slowly' end], lambda x: x is not null)"""
_TIMES = """case k when 0 then ['', 'forever', 'without end'] when 1 then ['once', 'one time'] when 2 then ['twice', 'two times'] when 3 then ['three times', 'thrice']
  else [k || ' times', 'for ' || k || ' cycles', k || 'x'] end"""


def _sql_texts(ids: str, id_col: str, seed: int = 1) -> str:
    """CTEs that end in tx: what realize() says for the frames, from the definition of each choice."""
    key = lambda slot: f"'{seed}|' || {id_col} || '|{slot}'"
    below = lambda slot, n: sql_draw(key(slot), n)
    one_of = lambda slot, options: f"{sql_list(options)}[1 + {below(slot, len(options))}]"
    heads = " ".join(
        f"when action = '{a}'{f" and level = '{v}'" if v else ''} then {one_of('head', forms)}"
        for a, bank in HEADS.items() for v, forms in (bank.items() if isinstance(bank, dict) else [(None, bank)])
    )
    spelt = f"list_transform(which, lambda w: case w when 'g' then {V.GROUP_NAME.sql(key('group'))} " + " ".join(f"when '{i}' then {V.NAME.sql(key(f'name{i}'))}" for i in range(3)) + " end)"
    return f"""{_sql_frames(ids, id_col, seed)},
  t0 as (select *, {spelt} as spelt, cast(interval_ms as bigint) as ms, cast(rounds as bigint) as k, case {heads} end as head, {one_of('pin style', N.PIN_STYLES)} as style,
    {sql_choice(N.DETERMINERS, key('determiner'))} as det, {one_of('every word', N.EVERY)} as every_word, {one_of('joiner', N.JOINERS)} as joiner, {below('terse', SCALE)} < {int(N.SHARES['terse'] * SCALE)} as terse from fr),
  t1 as (select *, list_transform(pins, lambda p: replace(style, '{{n}}', p::varchar)) as said_pins, list_transform(spelt, lambda n: det || n) as said_names, {_FORMS} as forms, {_TIMES} as times from t0),
  t2 as (select *, case when every then [every_word] when turned then list_concat(said_names, said_pins) else list_concat(said_pins, said_names) end as said,
    case when every then ['all'] when turned then list_concat(spelt, list_transform(pins, lambda p: p::varchar)) else list_concat(list_transform(pins, lambda p: p::varchar), spelt) end as short from t1),
  t3 as (select *, case when len(said) = 0 then 'it all' when action = 'alias' then array_to_string(said[1 : len(said) - 1], ', ') || ' is ' || said[len(said)] when len(said) < 2 then said[1]
    else array_to_string(said[1 : len(said) - 1], ', ') || joiner || said[len(said)] end as ref from t2),
  t4 as (select {id_col}, case when terse then concat_ws(' ', action, array_to_string(short, ' '), level, ms || 'ms', 'x' || k)
      else concat_ws(' ', replace(head, '{{r}}', ref) || case when action in ('set', 'read') then {sql_choice(N.WHERE, key('where'))} else '' end,
        forms[1 + {below('rate words', 1 << 30)} % greatest(1, len(forms))], nullif(case when k is not null then times[1 + {below('count words', 1 << 30)} % greatest(1, len(times))] end, '')) end as said,
    case when terse then 'terse' when regexp_matches(head, '^(what does|is|does) ') then 'question' when starts_with(head, '{{r}}') then 'bare' else 'imperative' end as mood, {key('dress')} as key from t3),
  t5 as (select *, case mood {_DRESSED} end as dressed from t4),
  tx as (select {id_col}, mood, case mood {_CASED} end as text from t5)"""


@query(f"with {_sql_texts('events', 'event_id')} select event_id, text from tx")
def generated_texts(spark, sf_dir):
    """A frame for each event, in words."""
    rows = N.realize(N.with_frames(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))))
    return rows.select(F.col("id").alias("event_id"), "text")
