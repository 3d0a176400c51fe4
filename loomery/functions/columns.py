"""Names of columns: free ones for helpers, and unambiguous references."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames uses, whatever its case."""
    used = {c.lower() for df in frames for c in df.columns}
    while base.lower() in used:
        base = f"_{base}"
    return base


def quoted(name: str) -> str:
    """A column name as a reference, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def staged(df: DataFrame) -> DataFrame:
    """df as a stage of its own: what is above it refers to its columns and does not repeat their expressions.

    The optimizer merges projections, and a long expression that is read in many places is then copied to each; with a few such
    steps plans grow beyond all bounds. Observing the rows costs a count and keeps the steps apart, without a cache or shuffle.
    """
    return df.observe(f"stage-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))
