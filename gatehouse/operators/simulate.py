"""What a principal can see, and why."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from .store import catalog


def decisions(documents: DataFrame, permissions: Column | Iterable[str]) -> DataFrame:
    """One row per document, no text: its policy, visible, reason."""
    made = documents.withColumn("_d", policy.explain("grants", "denies", permissions))
    return made.select("document_id", "title", "uri", "connector", policy.ids("grants").alias("grants"), policy.ids("denies").alias("denies"), F.col("_d.admitted").alias("visible"), F.col("_d.reason").alias("reason"))


def simulate(documents: DataFrame, permissions: Iterable[str], limit: int = 500) -> DataFrame:
    """Decisions over the first ``limit`` documents of the catalogue."""
    listed = catalog(documents, limit)
    return decisions(listed, permissions).orderBy("document_id")


def visible_counts(decided: DataFrame) -> DataFrame:
    """One row: visible_count, total_listed."""
    return decided.agg(F.count_if("visible").alias("visible_count"), F.count("*").alias("total_listed"))
