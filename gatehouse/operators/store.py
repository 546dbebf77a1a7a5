"""Document and chunk tables: reads behind the policy, upserts, fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy, text


def last_version(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of the rows of a key, the last by ``order`` (by hash among equal ones). Spark keeps one row per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_fingerprints(documents: DataFrame) -> DataFrame:
    """Adds content_hash and fingerprint and puts the policy in order."""
    out = documents.withColumns({"grants": policy.ids("grants"), "denies": policy.ids("denies"), "content_hash": text.content_hash("text")})
    return out.withColumn("fingerprint", policy.fingerprint("content_hash", "grants", "denies"))


def changed_only(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming documents that aren't stored with the same fingerprint."""
    return incoming.join(stored.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_anti")


def replace_documents(stored: DataFrame, incoming: DataFrame, *, documents: DataFrame | None = None) -> DataFrame:
    """``stored`` without the rows of the documents that come in, and the incoming rows.

    documents: the ids that are replaced, if not all of them have rows in
    ``incoming`` (a document may have no chunk left).
    """
    gone = (incoming if documents is None else documents).select("document_id").distinct()
    return stored.join(gone, "document_id", "left_anti").unionByName(incoming)


def delete_documents(stored: DataFrame, document_ids: DataFrame) -> DataFrame:
    return stored.join(document_ids.select("document_id").distinct(), "document_id", "left_anti")


def chunks_with_sources(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks and the source fields of their documents."""
    return chunks.join(documents.select("document_id", "connector", "uri", "title", "version"), "document_id")


def get_chunks(chunks: DataFrame, documents: DataFrame, wanted: DataFrame, permissions: Iterable[str]) -> DataFrame:
    """The wanted chunks that the permissions admit, with ``position`` to order by; unknown ids are skipped.

    wanted: chunk_id, position. The text lies behind the chunk's own policy.
    """
    mine = chunks.where(policy.admits("grants", "denies", permissions))
    return chunks_with_sources(mine.join(wanted, "chunk_id"), documents)


def list_documents(documents: DataFrame, permissions: Iterable[str], limit: int) -> DataFrame:
    """Summaries of the documents that are admitted, by id; no text."""
    if limit <= 0 or not set(permissions):
        return summaries(documents).limit(0)
    return summaries(documents.where(policy.admits("grants", "denies", permissions))).orderBy("document_id").limit(limit)


def summaries(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", "connector", "uri", "title", "version", "content_hash", "grants", "denies")


def catalog(documents: DataFrame, limit: int) -> DataFrame:
    """All summaries by id, for administrators; no text."""
    return summaries(documents).orderBy("document_id").limit(max(0, limit))


def counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks."""
    return documents.agg(F.count("*").alias("documents")).crossJoin(chunks.agg(F.count("*").alias("chunks")))
