"""Versioned Parquet tables: a version adds rows and ends others; a file that names its parts makes it visible."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..errors import StoreError

#: Tables that grow by parts, and small ones that each version has whole.
PARTED = {"documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "index": schemas.INDEX}
WHOLE = {"policies": schemas.POLICIES, "quant": schemas.QUANT}
TABLES = PARTED | WHOLE


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where tables that all hosts need may be written; local sessions without a checkpoint folder get a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise StoreError("set spark.checkpoint.dir to a folder that all hosts share")
    # One a local application, as a session can't set this folder later.
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='gatehouse-')}"
    return _local[app]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: nothing is computed twice, and lost executors cost a read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """``root``/<table>/p=<part> and ``root``/versions/<n>.

    A part is what one version adds: rows of each parted table, and in ``gone``
    the documents whose rows of earlier parts end with it. So a version costs
    what changes, not what there is; `compact` writes a part anew from all.
    A version's file lists its parts. It is written last and only if no other
    writer took the number, so readers see a version whole or not at all, and
    of two writers that began with the same version one fails. Old versions
    stay for readers that began with them. Paths may be of any store that Spark
    reads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def current(self) -> int | None:
        """The latest version, or None."""
        files, folder = self._file("versions")
        if not files.exists(folder):
            return None
        return max((int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit() and f.getLen()), default=None)

    def manifest(self, version: int) -> dict:
        try:
            return json.loads(self.spark.read.text(f"{self.root}/versions/{version}", wholetext=True).first()[0])
        except Exception as e:
            raise StoreError(f"version {version} can't be read ({type(e).__name__})") from None

    def read(self, version: int | None = None) -> dict[str, DataFrame] | None:
        """All tables of one version; None if there is none yet."""
        version = self.current() if version is None else version
        if version is None:
            return None
        known = self.manifest(version)
        out = {name: self.spark.read.schema(schema).parquet(f"{self.root}/{name}/p={known['parts'][-1]}") for name, schema in WHOLE.items()}
        gone = self._parts("gone", known["parts"], T.StructType([T.StructField("document_id", T.StringType())])).groupBy("document_id").agg(F.max("p").alias("until"))
        for name, schema in PARTED.items():
            rows = self._parts(name, known["parts"], schema)
            if len(known["parts"]) > 1:
                over = gone.select(F.col("document_id").alias("ended"), "until")
                rows = rows.join(over, (F.col("document_id") == F.col("ended")) & (F.col("p") < F.col("until")), "left_anti")
            out[name] = rows.select(schema.names)
        return out

    def _parts(self, name: str, parts: list[str], schema: T.StructType) -> DataFrame:
        fields = T.StructType([*schema.fields, T.StructField("p", T.StringType())])
        read = self.spark.read.option("basePath", f"{self.root}/{name}").schema(fields)
        return read.parquet(*[f"{self.root}/{name}/p={p}" for p in parts])

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that a version under way needs more than once: written to the root's staging folder and read again."""
        path = f"{self.root}/staging/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def note_set_aside(self, rows: DataFrame) -> int:
        """Add rows (document_id, uri, reason) to what was set aside; returns how many there are."""
        seen = Observation()
        rows.select("document_id", "uri", "reason", F.current_timestamp().alias("at")).observe(seen, F.count("*").alias("n")).write.mode("append").parquet(f"{self.root}/set_aside")
        return seen.get["n"]

    def set_aside(self) -> DataFrame:
        """Documents that weren't ingested, when and why: document_id, uri, reason, at."""
        shape = "document_id string, uri string, reason string, at timestamp"
        files, path = self._file("set_aside")
        return self.spark.read.schema(shape).parquet(f"{self.root}/set_aside") if files.exists(path) else self.spark.createDataFrame([], shape)

    def note_ranges(self, histograms: DataFrame, version: int, fitted: bool = False) -> None:
        """Add how a version's vectors lie in the int8 ranges (dimension, cells); ``fitted``: the ranges are this version's own."""
        histograms.select("dimension", "cells", F.lit(version).alias("version"), F.lit(fitted).alias("fitted")).coalesce(1).write.mode("append").parquet(f"{self.root}/ranges")

    def ranges(self) -> DataFrame:
        """(version, dimension, cells) since the ranges were fitted last."""
        shape = "dimension int, cells array<long>, version int, fitted boolean"
        files, path = self._file("ranges")
        if not files.exists(path):
            return self.spark.createDataFrame([], shape).drop("fitted")
        all_ = self.spark.read.schema(shape).parquet(f"{self.root}/ranges")
        last = all_.where("fitted").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        return all_.where(F.col("version") >= last).drop("fitted")

    def publish(self, tables: Mapping[str, DataFrame | None], gone: DataFrame | None = None, *, after: int | None = None, anew: bool = False) -> int:
        """Write a part and the version that ends with it; returns the version.

        tables: rows to add, and policies and quant whole. gone: ids of the
        documents whose earlier rows end. after: the version that this one was
        made from. anew: the part is all there is. The index is sorted by
        policy within its files, so that row groups are skipped.
        """
        version = (after or 0) + 1
        part = f"{version:08d}-{uuid.uuid4().hex}"
        for name, schema in TABLES.items():
            rows = tables.get(name)
            rows = self.empty(name) if rows is None else rows.select(schema.names)
            if name == "index":
                rows = rows.sortWithinPartitions("policy_id")
            rows.write.parquet(f"{self.root}/{name}/p={part}")
        (self.spark.createDataFrame([], "document_id string") if gone is None else gone.select("document_id").distinct()).write.parquet(f"{self.root}/gone/p={part}")
        policies = self.spark.read.schema(WHOLE["policies"]).parquet(f"{self.root}/policies/p={part}")
        n, ids, keys = policies.agg(F.count("*"), F.count_distinct("policy_id"), F.count_distinct("policy_key")).first()
        if not n == ids == keys:
            raise StoreError("policies don't have ids of their own")
        parts = [*([] if anew or after is None else self.manifest(after)["parts"]), part]
        self._appear(version, json.dumps({"version": version, "parts": parts}))
        return version

    def _appear(self, version: int, text: str) -> None:
        """Make a version visible, whole: its text is written aside and the file renamed, which fails if there is one of this number.

        A writer that dies before the rename leaves a file that nobody reads.
        Stores like HDFS rename in one step and never over a file; a local disk
        leaves a moment between the test and the renaming.
        """
        files, aside = self._file(f"versions/.{version}-{uuid.uuid4().hex}")
        out = files.create(aside, False)
        out.write(text.encode())
        out.close()
        _, path = self._file(f"versions/{version}")
        if files.exists(path) and not files.getFileStatus(path).getLen():
            files.delete(path, False)  # nobody's: a version is never empty
        if files.exists(path) or not files.rename(aside, path):
            files.delete(aside, False)
            raise StoreError(f"another writer published version {version}")

    def compact(self) -> int:
        """The latest version's rows as one part, as a new version; returns it."""
        now = self.current()
        if now is None:
            raise StoreError("there is no version to compact")
        return self.publish(self.read(now), after=now, anew=True)

    def bytes_of(self, name: str, version: int | None = None) -> int:
        """Bytes of the files of a table."""
        version = self.current() if version is None else version
        if version is None:
            return 0
        sizes = [self._file(f"{name}/p={p}") for p in self.manifest(version)["parts"]]
        return sum(files.getContentSummary(path).getLength() for files, path in sizes)
