"""The vector index: binary and int8 codes with interned policies; search under a permission set.

The policy filter is always the lowest operator of a search: policies are few,
so they are matched first, and their ids are pushed into the scan of the codes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequestError, VectorIndexError
from ..functions import policy, vectors
from ..plans.tables import written
from . import topk

#: Candidates that the Hamming stage keeps for each wanted row.
RESCORE = 64
#: More policy ids than this are joined and not listed in the filter.
LISTED_POLICIES = 1_000
#: Bytes of one of Spark's bitmaps.
_BUCKET_BYTES = 4096


def fit_int8(entries: DataFrame, vector: str = "vector", *, dimension: int | None = None) -> DataFrame:
    """One row: minimum, scale, dimension. A dimension without a range gets scale 1.

    Each task takes the minima and maxima of its vectors as matrices; only
    those, a row for each dimension, leave it.
    """
    if dimension is None:
        first = entries.select(F.size(vector)).first()
        if first is None:
            raise VectorIndexError("no vectors to fit on")
        dimension = first[0]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dimension, np.inf), np.full(dimension, -np.inf)
        # Whether a dimension has any component, as the ends of none are null.
        any_ = np.zeros(dimension, bool)
        for batch in batches:
            rows, known = _components(batch.column(0), dimension)
            if len(rows):
                any_ |= known.any(axis=0)
                # In Spark's order NaN is above all numbers.
                low = np.fmin(low, np.fmin.reduce(np.where(known, rows, np.inf), axis=0))
                high = np.maximum(high, np.where(known, rows, -np.inf).max(axis=0))
        at = np.flatnonzero(any_)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(low[at], pa.float64()), pa.array(high[at], pa.float64())], ["d", "low", "high"])

    of_tasks = entries.select(F.col(vector).cast("array<double>")).mapInArrow(ends, "d int, low double, high double")
    whole = of_tasks.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # A row a dimension.
    fitted = whole.agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct("low", "high")))).alias("m"))
    each = lambda field: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.try_element_at("m", i)[field])
    ranges = fitted.select(each("low").alias("minimum"), each("high").alias("_high"))
    scale = F.zip_with("_high", "minimum", lambda h, m: F.when(h - m == 0, F.lit(1.0)).otherwise(h - m))
    return ranges.select("minimum", scale.alias("scale"), F.lit(dimension).alias("dimension"))


def _components(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that aren't null as a matrix, and which of its components aren't null."""
    column = column.drop_null()
    flat = column.flatten()
    if any(n != dimension for n in pc.unique(pc.list_value_length(column)).to_pylist()):
        raise VectorIndexError("vectors have different dimensions")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dimension), flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def fit_entries(entries: DataFrame) -> DataFrame:
    """The ranges of the entries' normalised vectors, which `encode_entries` codes."""
    return fit_int8(entries.select(vectors.l2_normalize("vector").alias("vector")))


#: Cells of a dimension's histogram between the ends of its range.
CELLS = 16


def range_histograms(entries: DataFrame, quant: DataFrame) -> DataFrame:
    """(dimension, cells): how the components of normalised vectors lie in the ranges that codes are made with.

    cells: counts below the range, in CELLS equal parts of it, and above. Histograms of
    versions, tasks or batches add up cell by cell.
    """
    q = quant.first()  # one row: the ranges of the dimensions
    low, scale = np.array(q["minimum"]), np.array(q["scale"])
    dims = np.arange(len(low))
    # The upper end is in the range; rounding may put a bound just outside.
    slack = 1e-9

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(low), CELLS + 2), np.int64)
        for batch in batches:
            x, known = _components(batch.column(0), len(low))
            at = np.clip(np.floor((x - low) / scale * CELLS) + 1, 1, CELLS)
            at = np.where(x < low - slack, 0, np.where(x > low + scale + slack, CELLS + 1, at))
            place = (dims * (CELLS + 2) + np.nan_to_num(at, nan=CELLS + 1).astype(np.int64))[known]
            cells += np.bincount(place, minlength=cells.size).reshape(cells.shape)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), *[pa.array(c) for c in cells.T]], ["dimension", *names])

    names = [f"c{i}" for i in range(CELLS + 2)]
    of_tasks = entries.select(vectors.l2_normalize("vector").alias("vector")).mapInArrow(counts, "dimension int, " + ", ".join(f"{c} long" for c in names))
    return of_tasks.groupBy("dimension").agg(F.array(*[F.sum(c) for c in names]).alias("cells"))


def clipped_share(histograms: DataFrame, least_vectors: int = 1) -> float:
    """The share of components outside their ranges, of all histograms together; 0 if they count fewer vectors."""
    outside = F.element_at("cells", 1) + F.element_at("cells", CELLS + 2)
    row = histograms.agg(F.sum(outside), F.sum(F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x)), F.count_distinct("dimension")).first()
    return row[0] / row[1] if row[1] and row[1] >= least_vectors * row[2] else 0.0


def intern_policies(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(policy_id, policy_key, grants, denies) of all distinct policies; those known keep their ids.

    The key is a SHA-256; ids are dense numbers in the order of the key, which
    are given without gathering the policies in a task: they are sorted by
    ranges and written, and each range counts on from those before it.
    """
    found = entries.select(policy.ids("grants").alias("grants"), policy.ids("denies").alias("denies")).distinct().withColumn("policy_key", policy.policy_key("grants", "denies"))
    first = 0
    if known is not None:
        found = found.join(known.select("policy_key"), "policy_key", "left_anti")
        last = known.agg(F.max("policy_id")).first()[0]
        first = 0 if last is None else last + 1
    dealt = found.repartitionByRange("policy_key").sortWithinPartitions("policy_key")
    # The upper bits of this number are the range, the lower 33 count its rows.
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "policies")
    within, part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("_at", 33)
    offsets, so_far = [], first
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, so_far))
        so_far += n
    # A row a range, of which a shuffle has a stated number.
    starts = F.broadcast(entries.sparkSession.createDataFrame(offsets, "_part long, _start long"))
    numbered = placed.join(starts, part == F.col("_part")).select((F.col("_start") + within).alias("policy_id"), "policy_key", "grants", "denies")
    return numbered if known is None else known.select("policy_id", "policy_key", "grants", "denies").unionByName(numbered)


def policy_bitmaps(policies: DataFrame) -> DataFrame:
    """(principal, bucket, granted, denied): which policies name a principal, as bitmaps of 32,768 policies each."""

    def named(rules: str, column: str) -> DataFrame:
        by = policies.select(F.explode(rules).alias("principal"), (F.col("policy_id") + 1).alias("_p"))
        return by.groupBy("principal", F.bitmap_bucket_number("_p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias(column))

    return named("grants", "granted").join(named("denies", "denied"), ["principal", "bucket"], "full")


@F.arrow_udf(T.BinaryType())
def _and_not(granted: pa.Array, denied: pa.Array) -> pa.Array:
    out = []
    for g, d in zip(granted.to_pylist(), denied.to_pylist(), strict=True):
        bits = np.frombuffer(g or b"", np.uint8)
        out.append((bits & ~np.frombuffer(d, np.uint8)).tobytes() if d and len(bits) else bits.tobytes())
    return pa.array(out, pa.binary())


def admitted_bitmaps(held: DataFrame, policies: DataFrame) -> DataFrame:
    """(held, admitted): the policies that each permission set admits, as one bitmap, the policy's id being the bit.

    held: one column of distinct sets. Sets meet the bitmaps of their
    principals by an equality join; what any of them is granted is or-ed, and
    what any is denied taken away. Sets that nothing grants aren't returned.
    """
    met = held.select("held", F.explode("held").alias("principal")).join(policy_bitmaps(policies), "principal")
    by_set = met.groupBy("held", "bucket").agg(F.bitmap_or_agg(F.coalesce("granted", F.lit(b""))).alias("granted"), F.bitmap_or_agg(F.coalesce("denied", F.lit(b""))).alias("denied"))
    by_set = by_set.select("held", "bucket", _and_not("granted", "denied").alias("bits"))
    # Buckets (from 1 on) that a set lacks are empty.
    whole = F.map_from_entries(F.collect_list(F.struct("bucket", "bits")))
    empty = F.lit(bytes(_BUCKET_BYTES))
    return by_set.groupBy("held").agg(whole.alias("_m"), F.max("bucket").alias("_last")).select("held", F.unhex(F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), "_last"), lambda i: F.hex(F.coalesce(F.try_element_at("_m", i), empty))), "")).alias("admitted"))


def encode_entries(entries: DataFrame, policies: DataFrame, quant: DataFrame) -> DataFrame:
    """Index rows of entries (chunk_id, document_id, vector, grants, denies): codes and policy ids, no text."""
    unit = entries.withColumn("_v", vectors.l2_normalize("vector")).withColumn("policy_key", policy.policy_key("grants", "denies"))
    q = quant.first()  # one row: the ranges of the dimensions
    low, scale = vectors.literal(q["minimum"]), vectors.literal(q["scale"])
    coded = unit.join(policies.select("policy_key", "policy_id"), "policy_key")
    return coded.select("chunk_id", "document_id", "policy_id", vectors.binarize("_v").alias("bin"), vectors.int8_encode("_v", low, scale).alias("i8"))


@dataclass(frozen=True)
class VectorIndex:
    """Tables of an index: codes, policies, and the ranges the codes were made with."""

    codes: DataFrame
    policies: DataFrame
    quant: DataFrame
    bytes_on_disk: int = 0

    @classmethod
    def build(cls, entries: DataFrame) -> VectorIndex:
        """From entries (chunk_id, document_id, vector, grants, denies), one per chunk."""
        policies = intern_policies(entries)
        quant = fit_entries(entries)
        return cls(encode_entries(entries, policies, quant), policies, quant)

    def validate(self, chunks: int | None = None) -> VectorIndex:
        """Raises if codes aren't of the fitted dimension, name no stored policy, repeat a chunk, or aren't as many as ``chunks``."""
        q = self.quant.first()
        words = 0 if q is None else -(-q["dimension"] // 64)
        wrong = (F.size("i8") != (q["dimension"] if q else 0)) | (F.size("bin") != words)
        n, bad, ids = self.codes.agg(F.count("*"), F.count_if(wrong), F.count_distinct("chunk_id")).first()
        if bad or ids != n or chunks is not None and chunks != n or not self.codes.join(self.policies, "policy_id", "left_anti").isEmpty():
            raise VectorIndexError("the index doesn't fit its dimension, its policies or its chunks")
        return self

    def permitted(self, permissions: Iterable[str]) -> DataFrame:
        """The codes of the rows that the permissions admit."""
        admitted = self.policies.where(policy.admits("grants", "denies", permissions)).select("policy_id")
        few = [r[0] for r in admitted.limit(LISTED_POLICIES + 1).collect()]
        if len(few) <= LISTED_POLICIES:
            return self.codes.where(F.col("policy_id").isin(few)) if few else self.codes.where(F.lit(False))
        return self.codes.join(admitted, "policy_id", "left_semi")

    def search(self, query: Sequence[float], permissions: Iterable[str], k: int, *, rescore: int = RESCORE) -> DataFrame:
        """(chunk_id, document_id, score), best first: Hamming selection, then int8 scores; ties by chunk_id."""
        permissions = frozenset(permissions)
        if k <= 0:
            raise InvalidRequestError("k must be positive")
        if not permissions:
            return self.codes.sparkSession.createDataFrame([], "chunk_id string, document_id string, score double")
        q = self.quant.first()
        if len(query) != q["dimension"]:
            raise VectorIndexError("the query has another dimension than the index")
        length = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
        unit = [float(x) / length for x in query]
        weights, bias = vectors.fold_query(unit, q["minimum"], q["scale"])
        bits = F.array(*[F.lit(w) for w in binary_words(unit)])
        near = self.permitted(permissions).withColumn("_far", vectors.hamming("bin", bits))
        near = near.orderBy("_far", "chunk_id").limit(max(k, k * rescore))
        score = vectors.rescore("i8", vectors.literal(weights), bias)
        return near.select("chunk_id", "document_id", score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)

    def stats(self) -> DataFrame:
        """One row: rows, policies, principals, bytes and bytes per chunk (0 if empty)."""
        rows = self.codes.agg(F.count("*").alias("chunks"))
        named = self.policies.select(F.explode(F.concat("grants", "denies")).alias("p")).agg(F.count_distinct("p").alias("principals"))
        total = self.bytes_on_disk
        return rows.crossJoin(self.policies.agg(F.count("*").alias("policies"))).crossJoin(named).withColumns({"bytes_on_disk": F.lit(total).cast("long"), "bytes_per_chunk": F.coalesce(F.try_divide(F.lit(float(total)), F.col("chunks")), F.lit(0.0))})


def binary_words(vector: Sequence[float]) -> list[int]:
    """The binary code of a query vector, like `vectors.binarize`."""
    words = []
    for at in range(0, len(vector), 64):
        word = sum(1 << (63 - i) for i, x in enumerate(vector[at : at + 64]) if x > 0)
        words.append(word - (1 << 64) if word >> 63 else word)
    return words


def exact_top_k(rows: DataFrame, query: Column, k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) of the k largest inner products in double precision, ties by key."""
    return rows.select(key, vectors.dot(vector, query).alias("score")).orderBy(F.desc("score"), key).limit(k)


def folded(queries: DataFrame, quant: DataFrame, vector: str = "vector") -> DataFrame:
    """Queries with bin, weights and bias, so that an inner product with codes needs no decoding; quant is one row."""
    q = queries.join(F.broadcast(quant.select("minimum", "scale")))
    weights = F.zip_with(vector, "scale", lambda x, s: x.cast("double") * s / 255.0)
    parts = F.zip_with(vector, F.zip_with("scale", "minimum", lambda s, m: 128.0 * s / 255.0 + m), lambda x, y: x.cast("double") * y)
    bias = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return q.withColumns({"bin": vectors.binarize(vector), "weights": weights, "bias": bias}).drop("minimum", "scale")


def batch_search(index: VectorIndex, queries: DataFrame, k: int, *, candidates: int) -> DataFrame:
    """Search for many queries, each under its own permissions: query_id, rank, chunk_id, score.

    queries: query_id, permissions, vector. The distinct permission sets are
    matched with bitmaps of the policies, and the ids that any set admits are
    pushed into the scan of the codes. Each task keeps, by `topk.k_best`, the
    nearest ``candidates`` rows that a query's bitmap admits with their int8
    scores; of all of them the nearest are ranked by score.
    """
    asked = folded(queries.withColumns({"vector": vectors.l2_normalize("vector"), "held": policy.ids("permissions")}), index.quant)
    admitted = written(admitted_bitmaps(asked.select("held").where(F.size("held") > 0).distinct(), index.policies), "admitted")
    asked = written(asked.join(admitted, "held").select("query_id", "bin", "weights", "bias", "admitted"), "asked")
    few = _policies_of(admitted)
    codes = index.codes if few is None else index.codes.where(F.col("policy_id").isin(few)) if few else index.codes.limit(0)
    near = topk.k_best(codes.select("chunk_id", "policy_id", "bin", "i8"), asked, candidates, topk.scored_candidates, key="chunk_id", order="far long", more="score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def _policies_of(admitted: DataFrame) -> list[int] | None:
    """The policies that any of the bitmaps has; None if they are too many to list."""
    longest = admitted.agg(F.max(F.octet_length("admitted"))).first()[0]
    found = np.zeros(longest or 0, np.uint8)
    for (bits,) in admitted.select("admitted").distinct().toLocalIterator():
        own = np.frombuffer(bits, np.uint8)
        found[: len(own)] |= own
    ids = np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist()
    return ids if len(ids) <= LISTED_POLICIES else None


def recall_at_k(exact: DataFrame, found: DataFrame, k: int, *, key: str = "vec_id") -> DataFrame:
    """One row: queries, hits and recall (hits / (k * queries)). Both inputs: query_id, key."""
    hits = exact.join(found.select("query_id", key), ["query_id", key], "left_semi").agg(F.count("*").alias("hits"))
    asked = exact.agg(F.count_distinct("query_id").alias("queries"))
    return asked.crossJoin(hits).withColumn("recall", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("queries") * k), F.lit(0.0)))
