"""What a server would expose: retrieve, whoami, health, index, simulate, invalidate. No transport."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from ..errors import InvalidRequestError
from ..functions import text
from ..operators.index import VectorIndex
from ..operators.retrieve import Request, answer, payload
from ..operators.simulate import simulate
from ..plans.tables import Tables
from ..principals import Groups, Principal
from ..streaming.acl_cache import EpochCache
from .identity import identity
from .settings import Settings


class Api:
    """Reads the latest version of the tables at every call."""

    def __init__(self, spark: SparkSession, settings: Settings, rerank=None):
        self.spark, self.settings, self.rerank = spark, settings, rerank
        self.tables = Tables(spark, settings.root)
        groups = Groups.from_file(settings.groups_file) if settings.groups_file else Groups()
        self.cache = EpochCache(groups.resolve, ttl=settings.acl_ttl_seconds)

    def embed(self, query: str) -> list[float]:
        row = self.spark.createDataFrame([("q", query)], "id string, text string")
        return list(text.local_embeddings(row, "id", self.settings.dimension).first()["vector"])

    def retrieve(self, headers: Mapping[str, str], query: str, k: int = 10) -> dict:
        """The caller's best chunks, cited. The identity comes from the headers alone."""
        request = Request(identity(headers), query, k)
        return self.ask(request, self.cache(request.principal))

    def ask(self, request: Request, permissions: frozenset[str]) -> dict:
        """A batch of one request. Without permissions nothing is embedded or read."""
        now = self.tables.read() if permissions else None
        if now is None:
            return payload([], request.k)
        asked = self.spark.createDataFrame([("q", request.query, sorted(permissions), self.embed(request.query))], "query_id string, query string, permissions array<string>, vector array<float>")
        index = VectorIndex(now["index"], now["policies"], now["quant"])
        return payload(answer(index, now["chunks"], now["documents"], asked, request.k, candidate_k=request.candidate_k, rerank=self.rerank).collect(), request.k)

    def whoami(self, headers: Mapping[str, str]) -> dict:
        who = identity(headers)
        return {"principal": who.id, "groups": sorted(who.groups), "effective": sorted(self.cache(who))}

    def health(self) -> dict:
        now = self.tables.read()
        return {"status": "ok", **({n: now[n].count() for n in ("documents", "chunks")} if now else {"documents": 0, "chunks": 0})}

    def index(self) -> dict:
        now = self.tables.read()
        if not now:
            return {"chunks": 0, "policies": 0, "principals": 0, "bytes_on_disk": 0, "bytes_per_chunk": 0.0}
        return VectorIndex(now["index"], now["policies"], now["quant"], self.tables.bytes_of("index")).stats().first().asDict()

    def simulate(self, principal: str, groups: list[str], query: str | None = None, k: int = 10, limit: int = 500) -> dict:
        """Decisions over the listed documents as any principal, and a real query under the same permissions."""
        if query is not None and query and not query.strip():
            raise InvalidRequestError("the query is blank")
        who = Principal.of(principal, *groups)
        permissions = self.cache(who)
        now = self.tables.read()
        rows = [r.asDict() for r in simulate(now["documents"], permissions, limit).collect()] if now else []
        results = self.ask(Request(who, query, k), permissions) if query else None
        return {"principal": principal, "effective_principals": sorted(permissions), "documents": rows, "visible_count": sum(r["visible"] for r in rows), "total_listed": len(rows), "results": results}

    def invalidate(self, *, principal: str | None = None, group: str | None = None, everything: bool = False) -> None:
        """All before principal before group; one of them must be given."""
        if not (everything or principal or group):
            raise InvalidRequestError("nothing to invalidate")
        self.cache.signal(*(("all", "") if everything else ("principal", principal) if principal else ("group", group)))
