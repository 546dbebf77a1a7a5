"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder; on a
    cluster a machine-local folder would be invisible to the other hosts.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        # One a local application, as a session can't set this folder later.
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = f"file://{tempfile.mkdtemp(prefix='gatehouse-')}"
        shared = _local[app]
    return shared


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage: after an executor is lost, the rest of the job
    rereads these files and does not compute the input anew.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Bytes of rows that an executor and a Python worker hold of a task at once, about, in jobs that run in `small_batches`.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send rows to Python in batches of about BATCH_BYTES, or of one row if it has more.

    Spark's own batches are 10,000 rows or 64 MB. For texts, a task then holds
    a batch several times: as Arrow buffers, which double as they grow, in the
    executor, and as Arrow and Python strings in the worker. Only jobs that
    end inside count, so what is made there has to be written there.
    """
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def name(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{column.replace('`', '``')}`")


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """Columns ``more`` and a struct ``row`` of all columns of ``df``, so that no name clashes; ``row.*`` gives them back."""
    box = F.struct(*[name(c).alias(c) for c in df.columns]) if df.columns else F.struct(F.lit(None).alias("none"))
    return df.select(box.alias("row"), *[c.alias(n) for n, c in more.items()])


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows of the driver as a table.

    Spark reads plain rows in Python workers of their own, which stay a while
    beside those that run the functions; a local Arrow table needs none. Points
    in time stay plain, as Arrow takes those without a zone otherwise.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows or any(x in schema.simpleString() for x in ("timestamp", "interval")):
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame(pa.table([pa.array(list(c)) for c in zip(*rows, strict=True)], names=schema.names), schema)


#: Bits of a sieve: 8 MB, whatever it is made of.
_SIEVE_BITS = 1 << 26


def sieved(df: DataFrame, key: str, wanted: DataFrame, into: str = "maybe") -> DataFrame:
    """Add a boolean column: false where the long ``key`` is surely not among the keys of ``wanted`` (its only column).

    The keys set bits of a bitmap of a fixed size, which is broadcast. So rows
    with long texts of which few are wanted need not be shuffled to find out;
    what may be wanted is then joined as usual. Null keys are never wanted.
    """
    bit = lambda c: F.pmod(F.xxhash64(F.lit(17), c), F.lit(_SIEVE_BITS)) + 1
    named = wanted.toDF("_k").where("_k IS NOT NULL").select(bit(F.col("_k")).alias("_b"))
    maps = materialise(named.groupBy(F.bitmap_bucket_number("_b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_map")))
    at = F.bitmap_bit_position(bit(name(key)))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    # At most 2,048 maps of 4 KB.
    met = df.join(F.broadcast(maps), (F.bitmap_bucket_number(bit(name(key))) == F.col("_bucket")) & name(key).isNotNull(), "left")
    return met.select(*[name(c) for c in df.columns], F.coalesce(is_set, F.lit(False)).alias(into))


def crc_of_id(column: str):
    """crc32 of the decimal text of an id; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


def utf8_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of an Arrow array, without a copy; none for a null."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
        texts = texts.cast(pa.string())
    _, places, data = texts.buffers()
    if not len(texts):
        return
    at = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = texts.is_valid().to_pylist() if texts.null_count else None
    for i in range(len(texts)):
        yield data[at[i] : at[i + 1]] if valid is None or valid[i] else data[:0]


#: What this worker keeps between tasks, and what it was made for.
_held: list = []


def held(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` makes, kept by a Python worker until something else is asked for.

    A worker outlives tasks, stages and queries, and so would the models and
    memories of all operators that it has run. It keeps one of them.
    """
    if not _held or _held[0] != kind or not (_held[1] is key or _held[1] == key):
        let_go()
        _held[:] = kind, key, make()
    return _held[2]


def let_go() -> None:
    """Give back what is kept."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
