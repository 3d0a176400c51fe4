"""A corpus through five stages: toxicity, line deduplication, near duplicates, benchmark passages, sampled tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
The first four return the columns of documents: rejected documents are gone, and n_chars follows the text.

Defined results: a document with a null or empty text is never toxic beyond the model's intercept, has no line to lose, links
with nothing and holds no benchmark passage, so it comes through to its one empty segmentation. Documents with a null doc_id
keep all their lines and are never copies. Rows that repeat a doc_id are judged row by row, but for near copies: of a group the
rows of the smallest doc_id stay, all of them. Extra columns are carried through the first four stages, whatever their names;
an empty table gives an empty one. Ties between copies cannot be: doc_ids that are equal are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import decontaminate, jaccard_join, line_dedup, sampled_pieces, toxicity
from loomery.llm.shared import free_name, written

PIECES = "piece_bpe_32k.model"  # of the public tokenizers


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    The model is fitted on the documents table that the labels speak of, not on what a stage before may have left.
    """
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fitted(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score")
    return toxicity.score_toxicity(docs, model).where(F.col(score) < 0.5).drop(score)


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that three documents hold stay in the largest doc_id alone."""
    out = line_dedup.dedup_lines(docs, line_dedup.keep_bitmaps(docs)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays.

    Documents without words, or with a null doc_id, link with nothing and stay.
    """
    classes = jaccard_join.jaccard_classes(docs)
    copies = classes.where("doc <> component_id").select(F.col("doc").alias("copy")).distinct()
    return docs.join(copies, docs["doc_id"] == copies["copy"], "left_anti")


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    spans = next(c for c in found.columns[len(docs.columns) :] if c.endswith("hit_spans"))
    return found.where(F.size(spans) == 0).select(*docs.columns)


def sample_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text, with their scores and a digest of their ids."""
    import public_tokenizers

    return sampled_pieces.sample_pieces(docs, public_tokenizers.path(PIECES), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece sampling", sample_tokens),
]

#: A fitted model and sampled tokens are beyond SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
