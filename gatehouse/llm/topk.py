"""Exact top-k inner products over an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise, name

#: Vectors of a block of the index at most, and those that are worth a block; queries that one task runs against a block.
BLOCK, LEAST_BLOCK, BATCH = 32_768, 4_096, 65_536
#: Values that share a quantised impact.
STEP = 2
#: Shares of the segments after which the proof is tried.
TRIALS = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
#: The proof ends the scan if at most this share of the block may still be among the best.
FEW = 1 / 16
#: A vector's sum, and how many of its postings are in it, are added up in one number: the count stands above this bit.
_COUNT = 44
_LONG = (1 << 63) - 1


class ImpactIndex:
    """Posting segments of a block of integer vectors of one length.

    A posting says that a vector has some value in a dimension. Values are
    quantised to steps of STEP; the postings of a dimension with one quantised
    value form a segment, which lists its vectors. For a query, a segment's
    impact is its middle value times the query's component.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.stopped, self.first = ids, vectors, 0, 0
        self.wide = float(np.abs(vectors).max(initial=0)) >= 1 << 40
        dims, levels, self.postings, self.segments = [], [], [], []
        for d in range(0 if self.wide else vectors.shape[1]):
            level = vectors[:, d].astype(np.int64) // STEP
            order = np.argsort(level, kind="stable")
            values, starts = np.unique(level[order], return_index=True)
            # The number of each vector's segment in this dimension.
            self.segments.append(len(levels) + np.searchsorted(values, level))
            dims += [d] * len(values)
            levels += values.tolist()
            self.postings += np.split(order, starts[1:])
        self.dims, self.low = np.array(dims, np.int64), np.array(levels, np.int64) * STEP

    def best(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(-score, id) of the k vectors of highest inner product, ties to the smaller id, without id ``own``."""
        others = np.flatnonzero(self.ids != own)
        top = max(float(np.abs(query).max(initial=0)), 1.0) * max(float(np.abs(self.vectors).max(initial=0)) + STEP, 1.0) * 2 * len(query)
        if self.wide or top >= 1 << _COUNT - 2:
            # Beyond the numbers that the segments can add up: exact integers of any size.
            scores = self.vectors[others].astype(object) @ np.array([int(v) for v in query], dtype=object) if len(query) else np.zeros(len(others), object)
        else:
            others = others[self.possible(query.astype(np.int64), others, k)]
            scores = self.vectors[others].astype(np.int64) @ query.astype(np.int64)
            if len(scores) > k:
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                others, scores = others[scores >= edge], scores[scores >= edge]
        return sorted((-int(s), int(self.ids[i])) for s, i in zip(scores, others, strict=True))[:k]

    def possible(self, query: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
        """Places in ``others`` of the vectors that may be among its k best.

        Impacts are doubled, so that the middle of a step is an integer.
        Segments are added up from the largest impact on; many at once by what
        each vector has in each dimension, few one by one. When the largest of
        those left is t, a vector of which m postings are missing has a score
        within m * t, and what quantising adds, of its sum. Vectors whose most
        is under the k-th largest least are proven out; the scan stops when few
        are left. The proof is tried first a step before the last query's.
        """
        if len(others) <= k:
            return np.arange(len(others))
        impact = query[self.dims] * (2 * self.low + STEP - 1)
        order = np.argsort(-np.abs(impact), kind="stable")
        error, wanted = int(np.abs(query).sum()) * (STEP - 1), max(k, int(len(others) * FEW))
        stops = sorted({int(len(order) * share) for share in TRIALS} | {len(order)})
        values, size = impact + (1 << _COUNT), np.abs(impact)
        totals, at, own = np.zeros(len(self.ids), np.int64), 0, np.empty(len(self.ids), np.int64)
        first = min(self.first, len(stops) - 1)
        for trial, stop in enumerate(stops[first:], first):
            part = order[at:stop]
            if len(part) > len(query):
                added = np.zeros(len(order), np.int64)
                added[part] = values[part]
                for segments in self.segments:
                    totals += np.take(added, segments, out=own, mode="clip")
            else:
                for s in part.tolist():
                    totals[self.postings[s]] += values[s]
            at, self.first = stop, max(0, trial - 1)
            counts = (totals[others] + (1 << _COUNT - 1)) >> _COUNT
            sums = totals[others] - (counts << _COUNT)
            span = (len(query) - counts) * (int(size[order[at]]) if at < len(order) else 0) + error
            edge = np.partition(sums - span, len(others) - k)[len(others) - k]
            keep = np.flatnonzero(sums + span >= edge)
            if len(keep) <= wanted:
                break
        self.stopped += at < len(order)
        return keep


def usable(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x array<double>): floor(scale * component), whole numbers of any size.

    Rows with a null id go, and vectors that are null, empty or hold a null or
    non-finite component, scaled or not.
    """
    x = F.transform(name(embedding), lambda v: v.cast("double") * scale)
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(name(vec_id).cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND size(x) > 0").where(fine)
    # From 2^52 on, doubles are whole.
    return rows.select("vec_id", F.transform("x", lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)).alias("x"))


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """The k vectors of largest inner product for each query: query_id, rank, vec_id, score.

    Both inputs: vec_id long, x array<double> of whole numbers (see `usable`).
    Candidates are the vectors of the query's length with another id than its
    own; ties go to the smaller vec_id; with fewer than k candidates all are
    returned. Repeated rows of a vector are candidates of their own, and
    repeated rows of a query are queries of their own. A score beyond the range
    of a long is held to it. Empty inputs give an empty result.

    Vectors are dealt into blocks of at most about BLOCK, and each block's
    index is built by one task (for up to BATCH queries), through which the
    queries stream; it returns k rows a query. Those are merged by a window
    over the query, of which Spark keeps k rows a task before the shuffle.
    """
    spark = vectors.sparkSession
    # Numbered as they are written, so that equal queries stay apart.
    vectors, queries = materialise(vectors.select("vec_id", "x")), materialise(queries.select("vec_id", "x", F.monotonically_increasing_id().alias("number")))
    n, m = vectors.count(), queries.count()
    blocks = max(1, -(-n // BLOCK), min(spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    batches = max(1, -(-m // BATCH))
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id", "x"), F.lit(blocks))
    batch = F.pmod(F.xxhash64(F.lit(2), "number"), F.lit(batches))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"))
    index = vectors.withColumn("block", block).select("vec_id", "x", F.lit(-1).cast("long").alias("number"), "block", every(batches).alias("batch"))
    asked = queries.withColumn("batch", batch).select("vec_id", "x", "number", every(blocks).alias("block"), "batch")
    cells = index.unionByName(asked).withColumn("cell", F.col("block") * batches + F.col("batch")).drop("block", "batch")

    def search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The vectors of a cell come before its queries.
        cell, own, found = None, [], {}
        for batch in rows:
            for at, part in batch.groupby("cell", sort=True):
                if at != cell:
                    cell, own, found = at, [], {}
                asked = (part["number"] >= 0).to_numpy()
                own.append(part[~asked])
                out = []
                for q, number, x in part[asked][["vec_id", "number", "x"]].itertuples(index=False):
                    if own:
                        found = _indexes(pd.concat(own))
                        own = []
                    if (index := found.get(len(x))) is not None:
                        out += [(number, q, i, max(-_LONG - 1, min(_LONG, -s))) for s, i in index.best(x, q, k)]
                if out:
                    yield pd.DataFrame(out, columns=["number", "query_id", "vec_id", "score"]).astype("int64")

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = cells.repartition(min(tasks, blocks * batches), "cell").sortWithinPartitions("cell", "number").mapInPandas(search, "number long, query_id long, vec_id long, score long")
    ordered = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _indexes(rows: pd.DataFrame) -> dict[int, ImpactIndex]:
    """An index for each length of vectors."""
    rows = rows.sort_values("vec_id", kind="stable")
    lengths = rows["x"].map(len)
    return {int(n): ImpactIndex(part["vec_id"].to_numpy(np.int64), np.stack(part["x"].to_numpy())) for n, part in rows.groupby(lengths)}
