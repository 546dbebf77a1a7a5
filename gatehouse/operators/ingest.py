"""Incremental ingestion: skip what is unchanged, chunk, embed, index, publish one version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import InvalidDocumentError
from ..functions import policy, text
from ..plans.tables import Tables
from ..schemas import CHUNKS, DOCUMENTS
from . import index as ix
from .store import changed_only, last_version, with_fingerprints

#: (documents with columns chunk_id and text) -> (chunk_id, vector array<float>)
EmbedChunks = Callable[[DataFrame], DataFrame]
LONGEST_DOCUMENT_ID = 512
#: Share of components outside the int8 ranges, of all that came in since they were fitted, beyond which they are fitted anew.
MOST_CLIPPED = 0.01
#: Vectors since the ranges were fitted from which that share is judged: of fewer, a single one may be beyond it.
LEAST_JUDGED = 100


@dataclass(frozen=True)
class Report:
    documents: int
    chunks: int
    skipped_unchanged: int
    quarantined: int
    version: int
    refitted: bool = False


def valid_document_id(column: str) -> Column:
    """Non-empty, not padded, at most 512 characters, no control characters."""
    c = F.col(column)
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= LONGEST_DOCUMENT_ID) & ~c.rlike(r"(?U)^[\s\x1c-\x1f]|[\s\x1c-\x1f]$|[\x00-\x1f]"), F.lit(False))


def id_fault(column: str) -> Column:
    """What is wrong with a document's id; null if nothing."""
    c = F.col(column)
    faults = (c.isNull() | (F.length(c) == 0), "empty id"), (F.length(c) > LONGEST_DOCUMENT_ID, "id too long"), (~valid_document_id(column), "padded id or control characters in it")
    out = F.lit(None).cast("string")
    for is_wrong, why in reversed(faults):
        out = F.when(is_wrong, why).otherwise(out)
    return out


def chunk_id(document_id: Column | str, ordinal: Column | str) -> Column:
    return F.concat(document_id, F.lit("#"), F.col(ordinal).cast("string") if isinstance(ordinal, str) else ordinal.cast("string"))


def chunk_documents(documents: DataFrame, rules: text.Chunking | None = None) -> DataFrame:
    """Chunks (schemas.CHUNKS) that carry their document's policy."""
    cut = text.split_text(documents, rules)
    return cut.withColumn("text", F.col("chunk_text")).withColumn("chunk_id", chunk_id("document_id", "ordinal")).select(CHUNKS.names)


def ingest(tables: Tables, raw: DataFrame, embed: EmbedChunks, *, rules: text.Chunking | None = None, seq: str | None = None, prune: bool = False, skipped: DataFrame | None = None, most_clipped: float = MOST_CLIPPED) -> Report:
    """Bring the tables up to date with ``raw`` (schemas.RAW), as one new version.

    Rows with a malformed id are set aside with the reason, as is what the
    source has ``skipped`` (uri, error), and counted: see `Tables.set_aside`. Of the rows of a
    document the last by ``seq`` counts. Vectors are made before the version is
    published, so a failure publishes nothing and a retry starts afresh. The
    int8 ranges stay while at most ``most_clipped`` of the components that came
    in since lie outside; beyond, all chunks are coded anew (`refit`), once LEAST_JUDGED vectors came in. With ``prune``, documents that ``raw`` lacks are deleted.
    """
    fine = raw.where(valid_document_id("document_id"))
    aside = raw.select("document_id", "uri", id_fault("document_id").alias("reason")).where("reason IS NOT NULL")
    if skipped is not None:
        aside = aside.unionByName(skipped.select(F.lit(None).cast("string").alias("document_id"), "uri", F.concat(F.lit("unreadable: "), "error").alias("reason")))
    bad = tables.note_set_aside(aside)
    # Without a sequence any row of a document may be the last; the choice by hash is repeatable.
    last = last_version(fine.withColumn("_seq", F.col(seq) if seq else F.lit(0)), ["document_id"], "_seq").drop("_seq")
    incoming = with_fingerprints(last).select(DOCUMENTS.names)
    at = tables.current()
    old = tables.read(at)
    # Counted as they are written, without jobs of their own.
    of_new, of_chunks = Observation(), Observation()
    new = tables.stage("incoming", (changed_only(incoming, old["documents"]) if old else incoming).observe(of_new, F.count("*").alias("n")))
    gone = None
    if prune and old:
        gone = tables.stage("gone", old["documents"].select("document_id").join(fine.select("document_id"), "document_id", "left_anti"))
    n = of_new.get["n"]
    unchanged = last.count() - n
    if n == 0 and (gone is None or gone.isEmpty()):
        return Report(0, 0, unchanged, bad, at or 0)
    chunks = tables.stage("chunks_in", chunk_documents(new, rules).observe(of_chunks, F.count("*").alias("n"), F.count_if(~valid_span()).alias("wrong")))
    count = of_chunks.get["n"]
    if of_chunks.get["wrong"]:
        raise InvalidDocumentError("a chunk's span doesn't fit its text")
    entries = tables.stage("entries_in", chunks.join(embed(chunks.select("chunk_id", "text")), "chunk_id").select("chunk_id", "document_id", "vector", "grants", "denies"))
    policies = ix.intern_policies(entries, old["policies"] if old else None)
    out = {"policies": tables.stage("policies_in", policies)}
    if old and not old["quant"].isEmpty():
        out["quant"] = old["quant"]
    elif count:
        out["quant"] = tables.stage("quant_in", ix.fit_entries(entries))
    codes = ix.encode_entries(entries, out["policies"], out["quant"]) if count else None
    ended = new.select("document_id") if gone is None else new.select("document_id").unionByName(gone)
    version = tables.publish({**out, "documents": new, "chunks": chunks, "index": codes}, ended, after=at)
    if count:
        tables.note_ranges(ix.range_histograms(entries, out["quant"]), version)
    drifted = bool(count) and ix.clipped_share(tables.ranges(), LEAST_JUDGED) > most_clipped
    return Report(n, count, unchanged, bad, refit(tables, embed) if drifted else version, drifted)


def valid_span() -> Column:
    """Whether a chunk's span is one: it starts within the document, ends after its start, and is as long as its text."""
    return F.coalesce((F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start")) & (F.length("text") == F.col("span_end") - F.col("span_start")), F.lit(False))


def refit(tables: Tables, embed: EmbedChunks) -> int:
    """New int8 ranges and codes from the stored chunks; returns the version."""
    at = tables.current()
    now = tables.read(at)
    vectors = embed(now["chunks"].select("chunk_id", "text"))
    entries = tables.stage("entries_in", now["chunks"].join(vectors, "chunk_id").select("chunk_id", "document_id", "vector", "grants", "denies"))
    policies = tables.stage("policies_in", ix.intern_policies(entries))
    quant = tables.stage("quant_in", ix.fit_entries(entries))
    version = tables.publish({**now, "policies": policies, "quant": quant, "index": ix.encode_entries(entries, policies, quant)}, after=at, anew=True)
    tables.note_ranges(ix.range_histograms(entries, quant), version, fitted=True)
    return version


def local_embedder(dimension: int) -> EmbedChunks:
    """The built-in embedder: hashed features, native expressions."""
    return lambda chunks: text.local_embeddings(chunks, "chunk_id", dimension)


def remote_embedder(client: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, batch: int = 96) -> EmbedChunks:
    """An embedder behind a client: ``client()`` runs on an executor and returns texts -> vectors.

    Messages of its errors are dropped, as they may hold texts.
    """

    def run(batches):
        import pandas as pd

        from ..errors import EmbeddingError

        call = client()
        for part in batches:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                try:
                    found = call(some["text"].tolist())
                except Exception as e:
                    raise EmbeddingError(f"embedding failed ({type(e).__name__})") from None
                if len(found) != len(some) or any(len(v) != dimension for v in found):
                    raise EmbeddingError("embedding returned vectors of another number or dimension")
                yield pd.DataFrame({"chunk_id": some["chunk_id"].to_numpy(), "vector": [list(map(float, v)) for v in found]})

    return lambda chunks: chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, vector array<float>")


def policy_of_nobody(documents: DataFrame) -> DataFrame:
    """Documents whose policy is unknown: readable by no one."""
    return documents.withColumns({"grants": policy.no_ids(), "denies": policy.no_ids()})
