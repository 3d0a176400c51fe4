"""Line deduplication with DataFrame functions only.

Every long enough line becomes a 128-bit hash. The hashes are range-partitioned together with their document, with
document and position as secondary sort, so even a line that a third of all documents hold spreads over many tasks. A
streaming pass marks the first occurrence in each document; summing the marks gives the documents a line is in. What
comes back is not text but, for each document that loses lines, a run-length compressed keep bitmap.

Defined results: null and empty texts are one empty line. Rows that share a doc_id count as one document, and each keeps
its own lines. Rows with a null doc_id are returned as they are and count for nothing. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.shared import LOWER_FROM, LOWER_TO, free_name, partitions_for, quoted

BLANKS = " \t\n\x0b\x0c\r"
OPEN_END = 2**31 - 1


def ascii_lower(s: Column) -> Column:
    """A-Z in lower case; the fast built-in does it where the string is all ASCII."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, LOWER_FROM, LOWER_TO))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(quoted(id_col)).alias("doc"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("body")
    )


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = (
        _texts(docs, id_col, text_col)
        .where(F.col("doc").isNotNull())
        .select("doc", F.xxhash64("body").alias("body_hash"), F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .select("doc", "body_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
    )
    return lines.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "body_hash", "pos"
    )


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keeper: str = "last"
) -> DataFrame:
    """The documents that lose lines: (doc, body_hash, n_dropped, keep_runs).

    Lines whose key (ends stripped of ASCII blanks, A-Z lower-cased) has at least min_chars code points and is in at
    least min_docs documents go, except in the largest (keeper "last") or smallest ("first") doc_id that holds it.
    keep_runs is the keep bitmap in run-length form: (start, length) of each run of kept lines, the last one open-ended.
    """
    best = {"last": F.max, "first": F.min}[keeper]
    occ = _occurrences(docs, id_col, text_col, min_chars)
    occ = occ.repartitionByRange(partitions_for(docs.sparkSession), "h1", "h2", "doc").sortWithinPartitions(
        "h1", "h2", "doc", "body_hash", "pos"
    )
    in_doc = W.partitionBy("h1", "h2", "doc").orderBy("body_hash", "pos")
    repeated = (
        occ.withColumn("first", (F.row_number().over(in_doc) == 1).cast("long"))
        .groupBy("h1", "h2")
        .agg(F.sum("first").alias("n_docs"), best("doc").alias("kept_in"))
        .where(F.col("n_docs") >= min_docs)
        .select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "kept_in")
    )
    dropped = (
        occ.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("doc") != F.col("kept_in")))
        .groupBy("doc", "body_hash")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"))
    runs = F.transform(
        edges,
        lambda p, i: F.struct(
            (p + 1).alias("start"), (F.coalesce(F.get(F.col("gone"), i), F.lit(OPEN_END)) - p - 1).alias("length")
        ),
    )
    return dropped.select(
        "doc", "body_hash", F.size("gone").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("keep_runs")
    )


def dedup_lines(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped"
) -> DataFrame:
    """docs with the bitmaps applied to text, and the counts n_lines (before) and n_dropped added.

    If docs has columns of those names already, the new ones take underscores in front.
    """
    n_lines, n_dropped = free_name(docs, n_lines), free_name(docs, n_dropped)
    doc, body_hash, runs, lost = (free_name(docs, c) for c in ("bm_doc", "bm_hash", "bm_runs", "bm_lost"))
    marks = bitmaps.select(
        F.col("doc").alias(doc), F.col("body_hash").alias(body_hash), F.col("keep_runs").alias(runs), F.col("n_dropped").alias(lost)
    )
    body = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    lines = F.split(body, "\n", -1)
    kept = F.concat_ws("\n", F.flatten(F.transform(F.col(runs), lambda r: F.slice(lines, r["start"] + 1, r["length"]))))
    joined = docs.join(marks, (F.col(quoted(id_col)) == F.col(doc)) & (F.xxhash64(body) == F.col(body_hash)), "left")
    return joined.select(
        *[F.when(F.col(runs).isNull(), F.col(quoted(c))).otherwise(kept).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.col(lost), F.lit(0).cast("long")).alias(n_dropped),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents
), keyed as (
  select doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), repeated as (
  select k, max(doc_id) as kept_in from keyed where length(k) >= 20
  group by k having count(distinct doc_id) >= 3
), marked as (
  select a.doc_id, a.pos, a.line, r.k is not null and a.doc_id <> r.kept_in as gone
  from keyed a left join repeated r on a.k = r.k
)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
