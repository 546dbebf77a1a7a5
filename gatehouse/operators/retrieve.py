"""Retrieval for a batch of requests, as stages of DataFrames: search, fetch behind the policy, check again, rank, cite."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequestError, RerankError
from ..functions import policy
from ..principals import Principal
from ..schemas import RESULT
from .index import RESCORE, VectorIndex, batch_search
from .store import chunks_with_sources

MOST_CANDIDATES = 4_000
#: Ranges of a request's numbers, and of the characters of its query, a blank one having none.
LIMITS = {"k": (1, 1_000), "candidate_multiplier": (1, 1 << 31), "query": (1, 20_000)}
#: The columns of a citation.
CITED = ("connector", "uri", "title", "version", "span_start", "span_end", "document_id", "chunk_id")
#: An answer: the request, a row of schemas.RESULT, and how many candidates it was chosen from.
ANSWER = T.StructType([T.StructField("query_id", T.StringType()), *RESULT.fields, T.StructField("candidates", T.LongType())])

#: (query, texts, n) -> (position, score) of the best n.
Rerank = Callable[[str, Sequence[str], int], Iterable[tuple[int, float]]]


@dataclass(frozen=True)
class Request:
    """A checked request."""

    principal: Principal
    query: str = field(repr=False)
    k: int = 10
    candidate_multiplier: int = 4

    def __post_init__(self) -> None:
        measured = {"k": self.k, "candidate_multiplier": self.candidate_multiplier, "query": len(self.query) if self.query.strip() else 0}
        outside = [f"{what} ({least} to {most})" for what, (least, most) in LIMITS.items() if not least <= measured[what] <= most]
        if outside:
            raise InvalidRequestError(f"out of range: {', '.join(outside)}")

    @property
    def candidate_k(self) -> int:
        return min(self.k * self.candidate_multiplier, MOST_CANDIDATES)


def fetch_hits(hits: DataFrame, requests: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with the text and the source of their chunks, where the request's permissions admit the chunk.

    hits: query_id, chunk_id, score (null: 0). requests: query_id, permissions.
    An index that names too much gives nothing away: the text lies behind the
    chunk's own policy, which is tested as a filter of the join and again, by
    its explanation, on what was fetched. Unknown chunks are skipped.
    """
    asked = hits.join(requests.select("query_id", "permissions"), "query_id")
    mine = asked.join(chunks, "chunk_id").where(policy.admits("grants", "denies", F.col("permissions")))
    again = chunks_with_sources(mine, documents).where(policy.explain("grants", "denies", F.col("permissions"))["admitted"])
    return again.withColumn("score", F.coalesce("score", F.lit(0.0))).select("query_id", *RESULT.names[1:])


def rerank_hits(rows: DataFrame, requests: DataFrame, rerank: Rerank, n: int) -> DataFrame:
    """The rows that ``rerank`` chooses for each request, with its scores. A request has at most MOST_CANDIDATES rows."""
    schema = T.StructType([T.StructField("query_id", T.StringType()), *RESULT.fields[1:]])

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "chunk_id"], ascending=[False, True], ignore_index=True)
        chosen = list(rerank(rows["query"].iloc[0], rows["text"].tolist(), min(n, len(rows))))
        if any(not 0 <= at < len(rows) for at, _ in chosen):
            raise RerankError("a reranked position is out of range")
        return rows.iloc[[at for at, _ in chosen]].assign(score=[float(s) for _, s in chosen]).drop(columns="query")

    asked = rows.join(requests.select("query_id", "query"), "query_id")
    return asked.groupBy("query_id").applyInPandas(judge, schema)


def answer(index: VectorIndex, chunks: DataFrame, documents: DataFrame, requests: DataFrame, k: int, *, candidate_k: int, rerank: Rerank | None = None) -> DataFrame:
    """The best ``k`` chunks of every request, cited: columns of ANSWER, in no order.

    requests: query_id string, query, permissions array<string>, vector. A
    request without permissions has no answer.
    """
    able = requests.where(F.size(policy.ids("permissions")) > 0)
    hits = batch_search(index, able, candidate_k, candidates=candidate_k * RESCORE)
    rows = fetch_hits(hits, able, chunks, documents)
    counted = rows.groupBy("query_id").agg(F.count("*").alias("candidates"))
    return ranked(rows if rerank is None else rerank_hits(rows, able, rerank, k), k).join(counted, "query_id").select(ANSWER.names)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The best k rows of each request by falling score, ties by chunk, numbered from 1."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def payload(rows: Iterable, k: int) -> dict:
    """Nested values of one request's rows of `answer`, as a tool would return them."""
    told = sorted((r.asDict() for r in rows), key=lambda r: r["rank"])
    results = [{"text": r["text"], "score": r["score"], "citation": {c: r[c] for c in CITED}} for r in told]
    return {"requested_k": k, "returned": len(told), "candidates": told[0]["candidates"] if told else 0, "results": results}
