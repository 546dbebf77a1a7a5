"""Ranked lexical search over dual-sorted posting lists: a wavelet tree of each shard, searched best first."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise, name, utf8_rows

#: Postings of a shard, about, and pairs of item and term that are searched in one pass over the documents, about.
SHARD_POSTINGS, BATCH_TERMS = 1_000_000, 200_000
#: Nodes that are split at once, and ranges (terms of a node) that a search holds before it goes down first, which keeps few nodes.
WIDTH, RANGES = 48, 4_000_000
#: Fixed value: the bytes of terms, of which A to Z become a to z; all others part terms.
_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(data: np.ndarray) -> list[bytes]:
    """The terms of a text (UTF-8): runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return data.tobytes().translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms."""

    documents: int
    terms: int

    def impacts(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a posting scores before its term is weighed: grows with its occurrences and falls with the document's length."""
        m = 50 + (50 * length * self.documents) // max(1, self.terms)
        return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


class Shard:
    """The postings of some documents, by term and falling impact, as a wavelet tree of their document numbers.

    A term's postings are a range of the sequence, sorted by impact. On each
    level of the tree the postings are parted, in their order, by one bit of
    the document number. So the postings that a term has below a node are a
    range again, still sorted by impact: its first one bounds what the term can
    add to any document below the node. On the lowest level a node is a
    document and the bound is its score.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int, vocabulary: int):
        order = np.lexsort((doc, -impact, term))
        doc, impact, n = doc[order].astype(np.int64), impact[order], len(order)
        self.starts = np.searchsorted(term[order], np.arange(vocabulary + 1)).astype(np.int64)
        self.depth = max(1, (documents - 1).bit_length())
        # zeros[d, i]: postings before place i of level d that go left; first[d, i]: the impact at place i.
        self.zeros = np.zeros((self.depth, n + 1), np.int32)
        self.first = np.zeros((self.depth + 1, n + 1), np.int32)
        for d in range(self.depth):
            left = (doc >> (self.depth - 1 - d)) & 1 == 0
            np.cumsum(left, out=self.zeros[d, 1:])
            self.first[d, :n] = impact
            order = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
            doc, impact = doc[order], impact[order]
        self.first[self.depth, :n] = impact

    def bounds(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.where(lo < hi, self.first[level[:, None], lo], 0) @ weights

    def best(self, ids: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> list[tuple[int, int]]:
        """(score, document number) of the k documents of highest score, ties to the smaller number; scores under ``least`` are left out.

        Nodes are split in the order of their bounds, WIDTH at a time (fewer
        for an item of very many terms). What is below the k-th best score so
        far is never split; a bound that equals it is, as a tie may have a smaller number.
        """
        weights = weights.astype(np.int64)
        width = max(1, min(WIDTH, RANGES // (2 * max(1, len(ids)))))
        lo, hi = self.starts[ids][None], self.starts[ids + 1][None]
        level, number = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.bounds(level, lo, hi, weights)
        found_score, found_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            if len(bound) > width:
                # Of equal bounds the deeper ones first, which are nearer to a score.
                first = bound * 64 + level if lo.size <= RANGES else level * (1 << 56) + np.minimum(bound, (1 << 56) - 1)
                at = np.argpartition(-first, width)
                now, rest = at[:width], at[width:]
            else:
                now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            d, l, h, v = level[now], lo[now], hi[now], number[now]
            row = d[:, None]
            zl, zh, zeros = self.zeros[row, l].astype(np.int64), self.zeros[row, h].astype(np.int64), self.zeros[d, -1].astype(np.int64)[:, None]
            new_level, new_number = np.concatenate([d + 1, d + 1]), np.concatenate([2 * v, 2 * v + 1])
            new_lo, new_hi = np.concatenate([zl, zeros + l - zl]), np.concatenate([zh, zeros + h - zh])
            new_bound = self.bounds(new_level, new_lo, new_hi, weights)
            keep = new_bound >= least
            ends = keep & (new_level == self.depth)
            if ends.any():
                found_score, found_doc = np.concatenate([found_score, new_bound[ends]]), np.concatenate([found_doc, new_number[ends]])
                if len(found_score) > k:
                    order = np.lexsort((found_doc, -found_score))[:k]
                    found_score, found_doc = found_score[order], found_doc[order]
                if len(found_score) == k:
                    least = max(least, int(found_score.min()))
            keep &= ~ends
            level, number = np.concatenate([level[rest], new_level[keep]]), np.concatenate([number[rest], new_number[keep]])
            lo, hi, bound = np.concatenate([lo[rest], new_lo[keep]]), np.concatenate([hi[rest], new_hi[keep]]), np.concatenate([bound[rest], new_bound[keep]])
            alive = bound >= least
            if not alive.all():
                level, number, lo, hi, bound = level[alive], number[alive], lo[alive], hi[alive], bound[alive]
        order = np.lexsort((found_doc, -found_score))[:k]
        return list(zip(found_score[order].tolist(), found_doc[order].tolist(), strict=True))


class Collector:
    """Documents of a task, gathered into shards of about SHARD_POSTINGS postings of the terms that are asked for."""

    def __init__(self, asked: dict[bytes, int], corpus: Corpus, postings: int):
        self.asked, self.known, self.corpus, self.postings = asked, asked.keys(), corpus, postings
        self.start()

    def start(self) -> None:
        self.ids, self.lengths, self.doc, self.term, self.tf = [], [], [], [], []

    def add(self, doc_id: int | None, data: np.ndarray) -> bool:
        """Take a document; whether the shard is full."""
        found = terms(data)
        counts = Counter(found)
        mine = counts.keys() & self.known
        if mine:
            self.doc += [len(self.ids)] * len(mine)
            self.term += [self.asked[t] for t in mine]
            self.tf += [counts[t] for t in mine]
            self.ids.append(doc_id)
            self.lengths.append(len(found))
        return len(self.doc) >= self.postings

    def shard(self) -> tuple[Shard, list[int | None]]:
        """The shard, and the ids of its documents by number: ascending, so that ties fall to the smaller id (null last)."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        doc, tf = np.array(self.doc, np.int64), np.array(self.tf, np.int64)
        impact = self.corpus.impacts(tf, np.array(self.lengths, np.int64)[doc])
        made = Shard(number[doc], np.array(self.term, np.int64), impact, len(order), len(self.asked)), [self.ids[i] for i in order]
        self.start()
        return made


def _counted(docs: DataFrame, asked: list[bytes]) -> tuple[Corpus, dict[bytes, int]]:
    """The corpus, and of each asked term the documents that hold it. One row a batch of documents and term leaves a task."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(asked))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_term, documents, total = shared.value, Counter(), 0, 0
        for batch in batches:
            for data in utf8_rows(batch.column("text")):
                found = terms(data)
                documents += bool(found)
                total += len(found)
                of_term.update(known.intersection(found))
        yield pa.RecordBatch.from_pydict({"term": pa.array([None, None, *of_term], pa.binary()), "what": pa.array([0, 1, *[2] * len(of_term)], pa.int32()), "n": pa.array([documents, total, *of_term.values()], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "term binary, what int, n long").groupBy("what", "term").agg(F.sum("n").alias("n")).collect()
    totals = {r["what"]: r["n"] for r in rows if r["what"] < 2}
    return Corpus(totals.get(0, 0), totals.get(1, 0)), {bytes(r["term"]): r["n"] for r in rows if r["what"] == 2}


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", shard_postings: int = SHARD_POSTINGS, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """The k documents of highest score for each item: item_id, rank (from 1), doc_id, score.

    A document's score is the sum, over the item's distinct terms, of the
    term's weight, floor(1000 ln((2N + 2) / (2 df + 1))), times the posting's
    impact (`Corpus.impacts`); all else is whole numbers. Ties go to the
    smaller doc_id (null last); documents of score 0 aren't returned. Null and
    empty texts have no term, and items without one no result. Repeated rows of
    documents are documents of their own, and repeated rows of an item are
    items of their own. Other columns don't matter; empty tables give an empty
    result.

    The items' terms are dealt into batches of about ``batch_terms`` pairs,
    which are broadcast; for each batch the documents are read twice: once for
    the counts, and once to be gathered, where they lie, into shards. Every
    shard is searched for all items of the batch and returns k rows an item at
    most, of which a window keeps k. No text or posting is shuffled.
    """
    spark = docs.sparkSession
    slim = docs.select(name(doc_id).cast("long").alias("doc_id"), name(text).alias("text"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, number, data in zip(batch.column("item_id"), batch.column("number"), utf8_rows(batch.column("text")), strict=True):
                own = sorted(set(terms(data)))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(own), pa.int64()), pa.array([number.as_py()] * len(own), pa.int64()), pa.array(own, pa.binary())], ["item_id", "number", "term"])

    numbered = materialise(items.select(name(item_id).cast("long").alias("item_id"), name(item_text).alias("text"), F.monotonically_increasing_id().alias("number")))
    pairs = materialise(numbered.mapInArrow(part, "item_id long, number long, term binary"))
    batches = max(1, -(-pairs.count() // batch_terms))
    dealt = pairs.withColumn("batch", F.pmod(F.xxhash64("number"), F.lit(batches)))
    found = [_search(slim, dealt.where(F.col("batch") == b), k, shard_postings) for b in range(batches)]
    best = found[0] if len(found) == 1 else spark.createDataFrame([], found[0].schema)
    for part_found in found if len(found) > 1 else []:
        best = best.unionByName(materialise(part_found))
    return best.select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, pairs: DataFrame, k: int, shard_postings: int) -> DataFrame:
    spark = docs.sparkSession
    rows = [(r["item_id"], r["number"], bytes(r["term"])) for r in pairs.select("item_id", "number", "term").collect()]
    asked = {t: i for i, t in enumerate(sorted({t for _, _, t in rows}))}
    corpus, held = _counted(docs, list(asked))
    weight = _weights(spark, corpus, {t: held.get(t, 0) for t in asked})
    queries: dict[int, tuple[int | None, list[int], list[int]]] = {}
    for item, number, t in sorted(rows, key=lambda r: (r[1], r[2])):
        if held.get(t, 0) and weight[t] > 0:
            queries.setdefault(number, (item, [], []))
            queries[number][1].append(asked[t])
            queries[number][2].append(weight[t])
    wanted = [(number, item, np.array(ids, np.int64), np.array(w, np.int64)) for number, (item, ids, w) in queries.items()]
    shared = spark.sparkContext.broadcast((asked, corpus, wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, corpus, wanted = shared.value
        gathered, floors = Collector(asked, corpus, shard_postings), {}
        for batch in batches:
            for d, data in zip(batch.column("doc_id").to_pylist(), utf8_rows(batch.column("text")), strict=True):
                if gathered.add(d, data):
                    yield from answered(gathered, wanted, floors)
        yield from answered(gathered, wanted, floors)

    def answered(gathered: Collector, wanted: list, floors: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
        if not gathered.ids:
            return
        shard, ids = gathered.shard()
        out: list[tuple] = []
        for number, item, of_terms, weights in wanted:
            # What earlier shards of the task have found bounds what is of use from here on.
            scores = floors.get(number, [])
            best = shard.best(of_terms, weights, k, scores[-1] if len(scores) == k else 1)
            floors[number] = sorted([*scores, *[s for s, _ in best]], reverse=True)[:k]
            out += [(item, number, ids[d], s) for s, d in best]
        for at in range(0, len(out), 10_000):
            columns = list(zip(*out[at : at + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "number", "doc_id", "score"])

    hits = docs.mapInArrow(search, "item_id long, number long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _weights(spark, corpus: Corpus, held: dict[bytes, int]) -> dict[bytes, int]:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles, by Spark's logarithm."""
    counts = sorted(set(held.values()))
    if not counts:
        return {}
    weighed = F.floor(1000 * F.ln((F.lit(2.0) * corpus.documents + 2) / (F.lit(2.0) * F.col("df") + 1)))
    of_count = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in counts], "df long").select("df", weighed).collect()}
    return {t: of_count[c] for t, c in held.items()}
