"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import boxed, materialise, name, small_table

#: Patterns and sources are aggregates that go to the driver; more than this raises.
MAX_PATTERNS = 100_000
#: Documents that a bucket of the seeded order holds on average.
BUCKET_ROWS = 512
#: Buckets of a pattern, at most: the sums of one pattern are added up in one task.
MAX_BUCKETS = 65_536
#: Parts of the rows of the edge's bucket that are equal, so that no task numbers them all.
SALTS = 1024


def words_in(column: str):
    """Number of words: runs of characters other than the ASCII white space."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def fill_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; no share exceeds ``most`` times its size.

    What is above goes to the other shares by weight, until none is above.
    """
    capped: set[int] = set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        shares = [most * sizes[i] if i in capped else rest * weights[i] / weight for i in range(len(sizes))]
        above = {i for i, s in enumerate(shares) if i not in capped and s > most * sizes[i]}
        if not above:
            return shares
        capped |= above


class Flow:
    """Largest flow with integer capacities, by blocking flows in graphs of shortest distances.

    Edges may get more room after a run; the next run adds to the flow.
    """

    def __init__(self) -> None:
        self.number: dict[object, int] = {}
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.room: list[int] = []

    def node(self, label: object) -> int:
        if label not in self.number:
            self.number[label] = len(self.out)
            self.out.append([])
        return self.number[label]

    def edge(self, a: object, b: object, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[self.node(x)].append(len(self.to))
            self.to.append(self.node(y))
            self.room.append(r)
        return len(self.to) - 2

    def _distances(self, source: int) -> list[int]:
        far, layer = [-1] * len(self.out), [source]
        far[source] = 0
        while layer:
            after = []
            for a in layer:
                for e in self.out[a]:
                    if self.room[e] > 0 and far[self.to[e]] < 0:
                        far[self.to[e]] = far[a] + 1
                        after.append(self.to[e])
            layer = after
        return far

    def run(self, source: object, sink: object) -> None:
        source, sink = self.node(source), self.node(sink)
        while (far := self._distances(source))[sink] >= 0:
            tried, path, a = [0] * len(self.out), [], source
            while True:
                if a == sink:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    full = next(i for i, e in enumerate(path) if self.room[e] == 0)
                    a = self.to[path[full] ^ 1]
                    del path[full:]
                elif tried[a] < len(self.out[a]):
                    e = self.out[a][tried[a]]
                    if self.room[e] > 0 and far[self.to[e]] == far[a] + 1:
                        path.append(e)
                        a = self.to[e]
                    else:
                        tried[a] += 1
                elif path:
                    a = self.to[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break


def route(patterns: dict[tuple, int], quotas: dict[object, int], repeats: int) -> dict[tuple, dict[object, int]]:
    """Words that each pattern sends to each of its sources.

    patterns: total size of the documents that belong to exactly these sources.
    The n-th use of a document costs n - 1, so fresh documents go first and
    repetition spreads; the costs are convex, and the flow is the cheapest one
    that fills the quotas as far as they can be filled.

    Only the ways into the patterns cost anything, so the cheapest flow comes in
    rounds: the largest flow of first uses, what second uses can add to it, and
    so on. A round over patterns of one source each takes one pass of the graph.
    """
    flow, arcs = Flow(), {}
    ways = {p: flow.edge("start", ("pattern", p), 0) for p in patterns}
    for p, size in patterns.items():
        for s in p:
            arcs[p, s] = flow.edge(("pattern", p), ("source", s), repeats * size)
    for s, quota in quotas.items():
        flow.edge(("source", s), "end", quota)
    for _ in range(repeats):
        for p, e in ways.items():
            flow.room[e] += patterns[p]
        flow.run("start", "end")
    sent: dict[tuple, dict[object, int]] = {p: {} for p in patterns}
    for (p, s), e in arcs.items():
        sent[p][s] = flow.room[e ^ 1]
    return sent


def _fill_edge(table: pa.Table) -> pa.Table:
    """How many of each kind of row in the edge's bucket are taken: in seeded order while they fit.

    One more follows if that brings the sum nearer to the quota, the one that brings it nearest.
    """
    table = table.sort_by([(c, "ascending") for c in ("_seeded", "_size", "_rest", "_salt")])
    room, sizes, counts = table["_room"][0].as_py(), table["_size"].to_pylist(), table["_n"].to_pylist()
    take = []
    for size, n in zip(sizes, counts, strict=True):
        take.append(min(n, room // size) if size else n)
        room -= size * take[-1]
    left = [i for i, n in enumerate(counts) if take[i] < n]
    if left and abs(room - sizes[i := min(left, key=lambda i: abs(room - sizes[i]))]) < room:
        take[i] += 1
    return table.append_column("_take", pa.array(take, pa.int64()))


def mix_sources(docs: DataFrame, sources: str, quotas: dict[object, int], *, size: str = "size", doc_id: str = "doc_id", repeats: int = 2, seed: int = 42) -> DataFrame:
    """Choose how often the mix takes each document: adds ``copies`` and ``taken`` (copies * size).

    sources: array column, the sources that a document belongs to (distinct
    and sorted here; null: none). quotas: words wanted of each source; one that
    isn't named wants none. size: words of the document (null: 0).

    1. Documents are aggregated by membership pattern in Spark (with partial
       sums), and the min-cost flow of `route` runs over the patterns alone.
    2. A pattern that sends w words takes each of its documents w // its size
       times, and once more a seeded selection of w % its size words. The
       seeded order is cut into buckets of about BUCKET_ROWS documents, at most
       MAX_BUCKETS; sums of buckets tell which are taken whole. In the one
       bucket at the edge, documents are taken in seeded order while they fit,
       and one more if that is nearer. Only hashes, sizes and counts of that
       bucket go to one task, not its rows; equal rows are counted, and are
       numbered in SALTS parts where just some of them are taken. Reruns agree.

    Repeated rows count as documents of their own. Documents without a size, a
    source or a quota get taken = 0. Columns ``copies`` and ``taken`` of the
    input are replaced. The empty table gives the empty table.
    """
    repeats = max(1, repeats)
    spark, docs = docs.sparkSession, docs.drop("copies", "taken")
    kind = docs.schema[sources].dataType
    keyed = boxed(docs, _pattern=F.array_sort(F.array_distinct(F.coalesce(name(sources), F.array().cast(kind)))), _size=F.coalesce(name(size), F.lit(0)).cast("long"), _id=name(doc_id))
    stats = keyed.groupBy("_pattern").agg(F.sum("_size").alias("total"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(stats) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    stats.sort(key=lambda r: [(x is None, str(x)) for x in r["_pattern"]])
    totals = {tuple(r["_pattern"]): int(r["total"]) for r in stats if r["total"]}
    sent = route(totals, {s: int(q) for s, q in quotas.items()}, repeats)
    plan = []
    for r in stats:
        p = tuple(r["_pattern"])
        whole, part = divmod(sum(sent[p].values()), totals[p]) if p in totals else (0, 0)
        plan.append((list(p), whole, part, min(MAX_BUCKETS, max(1, r["n"] // BUCKET_ROWS))))
    kind = kind.simpleString()

    # Both broadcasts have one row for each pattern, so at most MAX_PATTERNS.
    planned = small_table(spark, [(i, *p) for i, p in enumerate(plan)], f"_no int, _pattern {kind}, _whole long, _part long, _buckets long")
    keyed = keyed.join(F.broadcast(planned), "_pattern").drop("_pattern")
    keyed = keyed.withColumn("_seeded", F.xxhash64(F.lit(seed), "_id", "_size")).withColumn("_bucket", F.pmod("_seeded", "_buckets")).drop("_id")
    sums = keyed.where("_part > 0").groupBy("_no", "_bucket").agg(F.sum("_size").alias("_sum"), F.first("_part").alias("_part"))
    upto = F.sum("_sum").over(Window.partitionBy("_no").orderBy("_bucket"))
    edges = sums.withColumn("_upto", upto).where("_upto > _part").groupBy("_no").agg(F.min(F.struct("_bucket", (F.col("_part") - F.col("_upto") + F.col("_sum")).alias("room"))).alias("e"))
    edges = [(r["_no"], r["e"]["_bucket"], r["e"]["room"]) for r in edges.collect()]
    edged = small_table(spark, edges, "_no int, _edge long, _room long")
    keyed = keyed.join(F.broadcast(edged), "_no", "left")

    at_edge = F.col("_edge").isNotNull() & (F.col("_bucket") == F.col("_edge"))
    more = F.when(F.col("_edge").isNotNull() & (F.col("_bucket") < F.col("_edge")), 1).otherwise(0).cast("long")
    clear = keyed.where(~at_edge).withColumn("_more", more)
    # Rows of one id and size are told apart by their other columns, of the types that can be hashed.
    rest = [F.col("row").getField(f.name) for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    edge = materialise(keyed.where(at_edge).withColumns({"_rest": F.xxhash64(F.lit(seed), *rest), "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))}))
    kinds = ["_no", "_seeded", "_size", "_rest", "_salt"]
    counts = edge.groupBy(*kinds).agg(F.count("*").alias("_n"), F.first("_room").alias("_room"))
    taken = materialise(counts.groupBy("_no").applyInArrow(_fill_edge, T.StructType([*counts.schema.fields, T.StructField("_take", T.LongType())])))
    met = edge.drop("_room").join(taken.drop("_room"), kinds)
    surely = met.where("_take = 0 OR _take = _n").withColumn("_more", F.least("_take", F.lit(1)).cast("long"))
    # Of rows that are equal in all that is hashed, it doesn't matter which are taken.
    number = F.row_number().over(Window.partitionBy(*kinds).orderBy("_seeded"))
    some = met.where("_take > 0 AND _take < _n").withColumn("_more", (number <= F.col("_take")).cast("long"))
    columns = ["row", "_whole", "_more", "_size"]
    copies = F.col("_whole") + F.col("_more")
    out = clear.select(columns).unionByName(surely.select(columns)).unionByName(some.select(columns))
    return out.select("row.*", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def mix_to_weights(docs: DataFrame, *, source: str = "source", size: str = "size", doc_id: str = "doc_id", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """Mix single-source documents: adds source_size, target, copies and taken.

    Sources in code point order, null last, weigh ``weights``, repeating. They
    share ``share`` times all sizes; see `fill_targets` for the ceiling.
    ``docs`` is read several times, so it had best be a table.
    """
    spark = docs.sparkSession
    docs = docs.drop("source_size", "target", "copies", "taken")
    sizes = docs.groupBy(name(source)).agg(F.sum(name(size)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sizes) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    sizes = {r[0]: int(r["n"] or 0) for r in sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))}
    if not sizes:
        return docs.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "copies": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")})
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    targets = fill_targets(list(sizes.values()), w, share * sum(sizes.values()), most)
    rows = [(s, n, float(t)) for (s, n), t in zip(sizes.items(), targets, strict=True)]
    known = small_table(spark, rows, f"of {docs.schema[source].dataType.simpleString()}, source_size long, target double")
    keyed = boxed(docs, id=name(doc_id), size=name(size), sources=F.array(name(source)))
    # One row for each source, so at most MAX_PATTERNS.
    keyed = keyed.join(F.broadcast(known), F.get("sources", F.lit(0)).eqNullSafe(F.col("of"))).drop("of")
    quotas = {s: round(t) for s, _, t in rows}
    mixed = mix_sources(keyed, "sources", quotas, doc_id="id", repeats=int(most), seed=seed)
    return mixed.select("row.*", "source_size", "target", "copies", "taken")
