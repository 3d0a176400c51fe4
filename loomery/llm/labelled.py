"""A bounded sample of labelled texts for the classifiers that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.shared import quoted, written


def fold_of(id_col, folds: int):
    return F.crc32(id_col.cast("string")) % folds


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    held_out,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 4000,
    max_bytes: int = 48 << 20,
) -> list[tuple[int, str]]:
    """(label, whole text) of at most per_class documents of each class and max_bytes in all, in an order fixed by hash.

    held_out(id) tells which ids are never used. Only ids and labels are ordered; just the chosen documents' texts move.
    Labels other than 0 and 1 and null ids are passed over; of several labels for one id the largest counts, of several
    texts for one id each is taken. The byte bound takes the same share from either class.
    """
    known = (
        labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").cast("int").alias("y"))
    )
    by_hash = F.xxhash64(F.lit("sample"), "id")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(by_hash, "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = chosen.collect()  # 2 * per_class ids at most
    if not rows:
        return []
    few = docs.sparkSession.createDataFrame(rows, known.schema)
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("body"))
    texts = written(texts.join(F.broadcast(few), "id").withColumn("h", by_hash).withColumn("n", F.octet_length("body")), "sample")
    sizes = texts.groupBy("y").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n or 0 for r in sizes)
    if total > max_bytes:  # whole documents in hash order, as many of each class as the bound allows
        ordered = sorted(texts.select("id", "h", "y", "n").collect(), key=lambda r: (r.h, r.id))
        left = {r.y: max_bytes * r.n / total for r in sizes}
        keep = set()
        for r in ordered:
            if r.n <= left[r.y]:
                left[r.y] -= r.n
                keep.add(r.id)
        texts = texts.join(F.broadcast(texts.sparkSession.createDataFrame([(i,) for i in keep], few.select("id").schema)), "id")
    return [(r.y, r.body) for r in sorted(texts.select("y", "body", "h", "id").collect(), key=lambda r: (r.h, r.id, r.body))]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a ridge on all but the intercept (last), by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w
