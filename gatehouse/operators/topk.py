"""The k best rows for every query of a batch, by bounded state: no pair of query and row becomes a row of Spark.

Queries are dealt into batches, which are broadcast; they are so many that
neither a batch nor what a task keeps for it is beyond a bound. For each, a task
reads its rows once, in blocks of matrices, and keeps the best k of each query;
only those leave it, as narrow rows, of which a window keeps k. So what is
shuffled is tasks x queries x k, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a batch of queries (vectors, codes and bitmaps), and rows of a block.
BATCH_BYTES, BLOCK_ROWS = 32 << 20, 65_536
#: Bytes of the best rows that a task keeps for a batch of queries; Python needs a few times as much while it merges and sends them.
KEPT_BYTES = 64 << 20
#: Queries whose products with a block are in memory at once; pairs whose scores are.
PRODUCTS_AT_ONCE, PAIRS_AT_ONCE = 32, 65_536

#: What is asked: a query's id, and arrays by name.
Query = tuple[object, dict[str, np.ndarray]]


@dataclass
class Best:
    """The best rows of a query so far: what they are ordered by (ascending), their keys, and more columns."""

    order: np.ndarray
    keys: np.ndarray
    more: np.ndarray

    def merged(self, other: Best, k: int) -> Best:
        order, keys, more = (np.concatenate([a, b]) for a, b in ((self.order, other.order), (self.keys, other.keys), (self.more, other.more)))
        at = np.lexsort((keys, order))[:k]
        return Best(order[at], keys[at], more[at])


def smallest(order: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest of ``order``, of equal ones those of the smallest ``ties`` (distinct): a selection, not a sort."""
    if len(order) <= k:
        return np.arange(len(order))
    edge = np.partition(order, k - 1)[k - 1]
    below, at_edge = np.flatnonzero(order < edge), np.flatnonzero(order == edge)
    need = k - len(below)
    if need < len(at_edge):
        at_edge = at_edge[np.argpartition(ties[at_edge], need - 1)[:need]]
    return np.concatenate([below, at_edge])


def left_to_right(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with ``b`` in double precision, added up from the first to the last component, as SQL does."""
    return np.cumsum(a.astype(np.float64) * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


class Block:
    """Rows as matrices: keys, their places in the order of keys, and columns."""

    def __init__(self, keys: np.ndarray, columns: dict[str, np.ndarray]):
        self.keys, self.columns, self._made = keys, columns, {}
        self.rank = np.empty(len(keys), np.int64)
        self.rank[np.argsort(keys, kind="stable")] = np.arange(len(keys))

    def once(self, what: object, make: Callable[[], object]):
        """What is the same for several queries is made once."""
        if what not in self._made:
            self._made[what] = make()
        return self._made[what]


def _matrix(column: pa.Array) -> np.ndarray:
    """Numbers, or a matrix of arrays of one length."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch], key: str, of: int) -> Iterator[Block]:
    """Blocks of at least ``of`` rows, but for the last one."""
    parts, n = [], 0
    for batch in batches:
        parts.append(batch)
        n += len(batch)
        if n >= of:
            yield _block(parts, key)
            parts, n = [], 0
    if n:
        yield _block(parts, key)


def _block(parts: list[pa.RecordBatch], key: str) -> Block:
    names = parts[0].schema.names
    columns = {c: np.concatenate([_matrix(p.column(c)) for p in parts]) for c in names if c != key}
    keys = np.concatenate([p.column(key).to_numpy(zero_copy_only=False) for p in parts])
    return Block(keys.astype(str) if keys.dtype == object else keys, columns)


def broadcast_batches(queries: DataFrame, batch_bytes: int, kept_bytes: int = 0) -> Iterator:
    """The queries (query_id, arrays) in broadcast lists of about ``batch_bytes``; ``kept_bytes``: that a task keeps for a query."""
    asked = queries.select("query_id", *[c for c in queries.columns if c != "query_id"])
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(sum([_bytes_of(asked, c) for c in asked.columns[1:]], F.lit(64))), F.lit(0))).first()
    parts = max(1, -(-int(size) // batch_bytes), -(-n * kept_bytes // KEPT_BYTES))
    dealt = asked.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts))) if parts > 1 else asked.withColumn("_part", F.lit(0))
    for part in range(parts):
        yield queries.sparkSession.sparkContext.broadcast([(r[0], {c: _array(r[c]) for c in asked.columns[1:]}) for r in dealt.where(F.col("_part") == part).drop("_part").toLocalIterator()])


def k_best(rows: DataFrame, queries: DataFrame, k: int, select: Callable[[Block, list[Query], int], Iterator[Best]], *, key: str, order: str, more: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(query_id, key, order, more) of the k rows of each query that come first by ``order``, ties by key.

    rows: ``key`` and the columns that ``select`` looks at, arrays of one
    length; rows with a null are left out. queries: query_id (distinct) and arrays. ``select`` gives
    the best of a block for each of some queries. order and more: names and types of the
    columns of numbers that it gives.
    """
    rows = rows.dropna()
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL(", ".join(filter(None, [order, more]))).fields]
    schema = T.StructType(fields)
    # Keys are kept in numpy's strings of one width, with four bytes a character.
    width = 4 * (rows.agg(F.max(F.length(key))).first()[0] or 0) if isinstance(fields[1].dataType, T.StringType) else 8
    found = None
    for these in broadcast_batches(queries, batch_bytes, k * (16 + width)):
        best = rows.mapInArrow(_partial(these, k, select, key, schema), schema)
        found = best if found is None else found.unionByName(best)
    first = Window.partitionBy("query_id").orderBy(fields[2].name, key)
    return found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")


def every_score(rows: DataFrame, queries: DataFrame, *, key: str, code: str = "i8", digits: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(query_id, key, score) of every row with every query: the inner product of ``code`` with ``weights``, from left to right, plus ``bias``.

    For results that have a row for each pair; `k_best` is for the best of them.
    Nothing is shuffled, and a task holds PAIRS_AT_ONCE scores or those of a
    row. digits: scores are rounded, halves away from zero, as SQL does.
    """
    schema = T.StructType([queries.schema["query_id"], rows.schema[key], T.StructField("score", T.DoubleType())])
    found = None
    for these in broadcast_batches(queries.select("query_id", "weights", "bias"), batch_bytes):
        own = rows.select(key, code).dropna().mapInArrow(_scored(these, digits, schema), schema)
        found = own if found is None else found.unionByName(own)
    return found


def _scored(shared, digits: int | None, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        if not asked:
            return
        ids = pa.array([q for q, _ in asked], _arrow_type(schema[0]))
        weights, bias = np.stack([a["weights"] for _, a in asked], axis=1).astype(np.float64), np.array([float(a["bias"]) for _, a in asked])
        step, every = max(1, PAIRS_AT_ONCE // len(asked)), np.arange(len(asked))
        for batch in batches:
            codes = _matrix(batch.column(1)).astype(np.float64)
            for at in range(0, len(codes), step):
                part = codes[at : at + step]
                score = np.zeros((len(part), len(asked)))
                for d in range(part.shape[1]):
                    score += part[:, d, None] * weights[d]
                score += bias
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(at, at + len(part)), len(asked))))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.tile(every, len(part)))), keys, pa.array(rounded(score, digits).ravel())], schema.names)

    return run


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves away from zero; numpy's own way is to the even number."""
    if digits is None:
        return x
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    return np.where(np.isfinite(scaled), (whole + np.where(np.abs(scaled - whole) >= 0.5, np.copysign(1.0, scaled), 0.0)) / 10.0**digits, x)


def _bytes_of(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    return F.octet_length(column) if isinstance(kind, (T.BinaryType, T.StringType)) else 8 * F.size(column) if isinstance(kind, T.ArrayType) else F.lit(8)


def _array(value):
    return np.frombuffer(value, np.uint8) if isinstance(value, (bytes, bytearray)) else np.array(value) if isinstance(value, list) else value


def _arrow_type(field: T.StructField) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[field.dataType.simpleString()]


def _partial(shared, k: int, select: Callable, key: str, schema: T.StructType):
    names, types = schema.names, [_arrow_type(f) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for block in blocks(batches, key, BLOCK_ROWS):
            for i, new in enumerate(select(block, shared.value, k)):
                if len(new.keys):
                    best[i] = best[i].merged(new, k) if i in best else new
        while best:
            # What is sent isn't kept.
            i, b = best.popitem()
            columns = [pa.array([shared.value[i][0]], types[0]).take(pa.array(np.zeros(len(b.keys), np.int64))), pa.array(b.keys), pa.array(b.order), pa.array(b.more)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=False)], names)

    return run


def nearest_codes(block: Block, queries: list[Query], k: int) -> Iterator[Best]:
    """By Hamming distance of ``bin``; ``more`` is the distance again."""
    for _, asked in queries:
        far = hamming(block.columns["bin"], asked["bin"])
        at = smallest(far, block.rank, k)
        yield Best(far[at], block.keys[at], far[at])


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    # As unsigned numbers: of negative ones numpy counts the bits of the absolute value.
    return np.bitwise_count((codes ^ code.astype(np.int64)).view(np.uint64)).sum(axis=1, dtype=np.int64)


def largest_products(block: Block, queries: list[Query], k: int) -> Iterator[Best]:
    """By falling inner product of ``vector``: what a matrix product finds near the k best is added up again, from left to right."""
    rows = block.columns["vector"].astype(np.float64)
    most = float(np.abs(rows).max(initial=0))
    for at in range(0, len(queries), PRODUCTS_AT_ONCE):
        asked = np.stack([a["vector"] for _, a in queries[at : at + PRODUCTS_AT_ONCE]]).astype(np.float64)
        for x, about in zip(asked, asked @ rows.T, strict=True):
            near = np.arange(len(about))
            if len(about) > k:
                # Sums in another order differ by far less than this.
                slack = 1e-10 * (1.0 + most * float(np.abs(x).sum()))
                near = np.flatnonzero(about >= np.partition(about, len(about) - k)[len(about) - k] - slack)
            exact = -left_to_right(rows[near], x)
            best = smallest(exact, block.rank[near], k)
            yield Best(exact[best], block.keys[near[best]], exact[best])


def scored_candidates(block: Block, queries: list[Query], k: int) -> Iterator[Best]:
    """Rows that the query's bitmap of policies admits, by Hamming distance; ``more`` is the int8 score."""
    for _, asked in queries:
        bits = asked["admitted"]
        # The few distinct bitmaps are looked up once for a block.
        at, codes, rank = block.once(bits.tobytes(), lambda bits=bits: _admitted(block, bits))
        far = hamming(codes, asked["bin"])
        best = smallest(far, rank, k)
        at = at[best]
        yield Best(far[best], block.keys[at], left_to_right(block.columns["i8"][at], asked["weights"]) + float(asked["bias"]))


def _admitted(block: Block, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, binary codes and ranks of the rows whose policy is set in a bitmap."""
    policy = block.columns["policy_id"].astype(np.int64)
    known = policy < 8 * len(bits)
    at = np.flatnonzero(known & ((bits[np.where(known, policy >> 3, 0)] >> (policy & 7).astype(np.uint8) & 1) == 1)) if len(bits) else np.zeros(0, np.int64)
    return at, block.columns["bin"][at], block.rank[at]
