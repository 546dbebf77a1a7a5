"""Latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """p50, p95, p99 (linear interpolation), mean, min, max and count, by group."""
    q = {f"p{p}": F.percentile(value, p / 100) for p in (50, 95, 99)}
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in q.items()], F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


#: Size of a sketch, and the rank error that it keeps to with a chance of over 99 %.
SKETCH_K, RANK_ERROR = 800, 0.01


def latency_sketches(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, sketch): KLL sketches, which merge: of days, of micro-batches (aggregations of streams), of tasks."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch"))


def sketched_summary(sketches: DataFrame, *by: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by, n, and a column like p95 for each point) of merged sketches: each value's rank is its point, within RANK_ERROR."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(p * 100)}") for p in points]
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), *quantiles)
