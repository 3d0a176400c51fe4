"""How far the sources of a language diverge in their words: shards are aggregated by DuckDB, Spark merges sums and ranks.

Each task counts the terms of its texts by language and source. The counts are shuffled into shards by language and term and
sorted there, so a shard is read in pieces that end with a term, of bounded size. DuckDB sums a piece's counts and keeps the
terms of enough documents; from the totals that Spark then merges it computes a piece's smoothed shares, its highest term
values of each source, and partial sums over pairs of sources. Of a pair, the shards sum only what terms in both sources add to
what they would add in either alone. The rest depends on how often a term occurs, and not on the term: it comes from
the number of terms of each count and source. No shard needs the other sources of its languages, and no term is paired
with a source that lacks it.

Defined results: null languages, sources and texts are ''. Each row is a document of its own, whatever its doc_id. A source
alone in its language has no pairs; in a language without kept terms all pairs have the value 0. Equal values rank by the
item's UTF-8. An empty table gives no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.shared import Scratch, lean, partitions_for, quoted

MIN_DOCS, TOP_TERMS, SHARE = 10, 10, 1_000_000_000
HELD_TERMS = 300_000
PIECE_ROWS = 200_000
SALTS, FEW_GROUPS = 16, 50_000
#: Bytes of UTF-8: letters in lower case, all other ASCII as a space; bytes of characters beyond ASCII stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = """
with summed as (select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from piece group by all),
kept as (select lang, term, sum(n)::bigint as lang_n, min(source) as first from summed group by all having sum(docs) >= {min_docs})
select lang, source, term, n, lang_n, (source = first)::int as lead from summed join kept using (lang, term)
"""
COLLAPSED = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from piece group by all"
DIVERGENCE = "create macro f(p, q) as (p - q) * (p - q) // (p + q)"
COMPARED = """
with shares as (
  select lang, source, term, 1 + ({share}::hugeint * (n + 2) // (total + 2 * v))::bigint as p,
         1 + ({share}::hugeint * 2 // (total + 2 * v))::bigint as z, 1 + ({share}::hugeint * (lang_n + 2) // (lang_total + 2 * v))::bigint as q
  from piece
),
pairs as (
  select a.lang, a.source, b.source as item, sum(f(a.p, b.p) - f(a.p, b.z) - f(a.z, b.p) + f(a.z, b.z)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all
),
terms as (
  select lang, source, term as item, f(p, q) as value from shares where p > q
  qualify row_number() over (partition by lang, source order by value desc, item) <= {top}
)
select 'pair' as part, lang, source, item, value::bigint as value from pairs
union all select 'term', lang, source, item, value::bigint from terms
"""


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held_terms: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed by task, not yet in all."""
    rows = docs.select(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def count(batches):
        import pyarrow as pa

        names = ["lang", "source", "term", "n", "docs"]
        occurring, holding, held = defaultdict(Counter), defaultdict(Counter), 0

        def given():
            for (lang, source), counter in occurring.items():
                terms = list(counter)
                held_by = holding[lang, source]
                for at in range(0, len(terms), 1 << 16):
                    some = terms[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                            pa.array([counter[t] for t in some], pa.int64()), pa.array([held_by[t] for t in some], pa.int64()),
                        ],
                        names=names,
                    )
            occurring.clear()
            holding.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                terms = text.as_buffer().to_pybytes().translate(TERM_BYTES).split()
                if terms:
                    own = occurring[lang, source]
                    held -= len(own)
                    own.update(terms)
                    held += len(own)
                    holding[lang, source].update(set(terms))
                if held > held_terms:
                    yield from given()
                    held = 0
        yield from given()

    return rows.mapInArrow(lean(count), "lang string, source string, term string, n long, docs long")


def sharded(rows: DataFrame, sql: str, schema: str, collapsed: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows shuffled and sorted by lang and term, and each piece of a shard put through a DuckDB query.

    A piece ends where a term does. collapsed is a query that sums up the rows of a single term, should they exceed a piece.
    """

    def shard(batches):
        import duckdb
        import pyarrow as pa
        import pyarrow.compute as pc

        con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        con.execute(DIVERGENCE)

        def asked(query, table):
            con.register("piece", table)
            out = con.execute(query).to_arrow_table()
            con.unregister("piece")
            return out

        def ended(table):
            """How many rows of a sorted table are of terms before its last."""
            lang, term = table.column("lang"), table.column("term")
            last = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1]))
            return table.num_rows - pc.sum(last).as_py()

        held, rows, limit = [], 0, piece_rows
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.Table.from_batches(held)
            cut = ended(table)
            if cut:
                yield from asked(sql, table.slice(0, cut)).to_batches(1 << 16)
                table = table.slice(cut).combine_chunks()
            elif collapsed:
                table = asked(collapsed, table).cast(table.schema)
            held, rows = table.to_batches(), table.num_rows
            limit = piece_rows + rows
        if rows:
            yield from asked(sql, pa.Table.from_batches(held)).to_batches(1 << 16)
        con.close()

    spread = rows.repartition(partitions_for(rows.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return spread.mapInArrow(lean(shard), schema)


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(lang, source, term, n, lang_n, lead) of the terms that min_docs documents of a language hold; lead is 1 once a term."""
    schema = "lang string, source string, term string, n long, lang_n long, lead int"
    return sharded(counts, COUNTED.format(min_docs=min_docs), schema, COLLAPSED, piece_rows)


def f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def with_totals(rows: DataFrame, totals: DataFrame, few: bool) -> DataFrame:
    """rows joined with the totals of their lang and source, which are broadcast if few; else large groups are salted."""
    if few:
        return rows.join(F.broadcast(totals), ["lang", "source"])
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("n", *[c for c in rows.columns if c == "term"]), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"]).drop("salt")


def audit_sources(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    share: int = SHARE,
    piece_rows: int = PIECE_ROWS,
    few_groups: int = FEW_GROUPS,
) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of a language by divergence ("pair"), and a source's terms ("term").

    A term counts for a language if min_docs of its documents hold it. A term's share in a source, or in a language, is
    p = 1 + floor(share * (count + 2) / (N + 2 * V)), with V terms that count and N occurrences of them. Terms are valued
    by f(p, q) = floor((p - q)^2 / (p + q)) against the language, and pairs by its sum over all terms that count.
    """
    held = Scratch(docs.sparkSession)
    kept = held.written(kept_counts(term_counts(docs, lang_col, source_col, text_col), min_docs, piece_rows), "audit-terms")
    groups = docs.select(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("n").alias("lang_total"))
    totals = held.written(groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0), "audit-totals")
    few = totals.count() <= few_groups
    schema = "part string, lang string, source string, item string, value long"
    compared = held.written(sharded(with_totals(kept, totals, few), COMPARED.format(share=share, top=top_terms), schema, None, piece_rows), "audit-shards")

    # what each source's terms add to a pair where the other source lacks them, from the number of terms of each count
    z = f"if(v > 0, 1 + (cast({2 * share} as decimal(38,0))) div (total + 2 * v), null)"
    p = f"1 + (cast(n + 2 as decimal(20,0)) * cast({share} as decimal(18,0))) div (total + 2 * v)"
    zeros = totals.select("lang", "source", "v", F.expr(z).alias("z"))
    others = zeros.select("lang", F.col("source").alias("item"), F.col("z").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = zeros.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).join(others, ["lang", "salt"]).where("source <> item").drop("salt")
    by_count = with_totals(kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")), totals, few).select("lang", "source", "m", F.expr(p).alias("p"))
    alone = pairs.join(by_count, ["lang", "source"]).select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), F.expr(f"m * ({f('p', 'w')} - {f('z', 'w')})").alias("value"))
    bare = pairs.where("source < item").select("lang", "source", "item", F.expr(f"coalesce(v * ({f('z', 'w')}), 0)").alias("value"))
    both = compared.where("part = 'pair'").select("lang", "source", "item", "value")
    summed = alone.unionByName(bare).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    directed = summed.select("lang", pair.alias("x"), "value").select(F.lit("pair").alias("part"), "lang", "x.source", "x.item", "value")
    order = W.partitionBy("part", "lang", "source").orderBy(F.desc("value"), "item")
    ranked = directed.unionByName(compared.where("part = 'term'")).withColumn("rank", F.row_number().over(order).cast("int"))
    out = ranked.where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
    return held.last(out.select("lang", "source", "part", "item", "value", "rank"), "audit")


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP12_SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as body from documents
), w as (
  select id, lang, source,
         unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from d
), c as (
  select lang, source, term, count(*) as n, count(distinct id) as docs from w group by all
), kept as (
  select lang, term, sum(n)::bigint as lang_n from c group by all having sum(docs) >= 10
), v as (
  select lang, count(*) as v, sum(lang_n)::bigint as lang_total from kept group by lang
), g as (
  select distinct lang, source from d
), dense as (
  select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, kept.lang_n from g join kept using (lang) left join c using (lang, source, term)
), totals as (
  select lang, source, sum(n)::bigint as total from dense group by all
), p as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2) // (total + 2 * v))::bigint as p,
         1 + (1000000000::hugeint * (lang_n + 2) // (lang_total + 2 * v))::bigint as q
  from dense join totals using (lang, source) join v using (lang)
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), rows as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
       left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q
)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from rows)
where part = 'pair' or rank <= 10
"""
