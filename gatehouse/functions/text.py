"""Text: chunk spans, hashed n-gram features, content hashes, redaction."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidDocumentError

#: The marks after which a sentence ends.
SENTENCE_ENDS = (". ", ".\n", "? ", "?\n", "! ", "!\n")
PARAGRAPH_END = "\n\n"
REDACTED = "[REDACTED]"
_WORD = re.compile(r"[a-z0-9]+")
#: Shapes of secrets, in the order of replacement, and what replaces them.
SECRETS = (
    (r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]+=*", f"Bearer {REDACTED}"),
    (r"\bya29\.[A-Za-z0-9\-._]+", REDACTED),
    (r"\bsk-[A-Za-z0-9_\-]{16,}", REDACTED),
    (r"\bAKIA[0-9A-Z]{16,}", REDACTED),
    (r"(?i)\b(token|secret|password|passwd|api[_-]?key|authorization)(\s*[=:]\s*)\S+", f"$1$2{REDACTED}"),
)


@dataclass(frozen=True)
class Chunking:
    """Longest chunk, and what two neighbouring chunks share, in code points."""

    max_chars: int = 1200
    overlap_chars: int = 150

    def __post_init__(self) -> None:
        # So every chunk ends after the one before it.
        if not 0 <= self.overlap_chars < self.max_chars:
            raise InvalidDocumentError(f"chunks of {self.max_chars} characters can't share {self.overlap_chars}")


def last_break(text: str, start: int, end: int) -> int:
    """Where a chunk that may reach to ``end`` is best cut.

    Not in its first quarter; after the last paragraph, or else the last
    sentence, or else the last white space; otherwise at ``end``.
    """
    least = start + max(1, (end - start) // 4)
    for marks in ((PARAGRAPH_END,), SENTENCE_ENDS):
        if cuts := [at + len(m) for m in marks if (at := text.rfind(m, least, end)) >= 0]:
            return max(cuts)
    return next((i + 1 for i in reversed(range(least + 1, end)) if text[i].isspace()), end)


def chunk_spans(text: str | None, rules: Chunking) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text, in code points; none for a blank text."""
    text = text or ""
    spans, start = [], 0
    # Once: each time copies the text.
    while spans or text.strip():
        end = min(len(text), start + rules.max_chars)
        if end == len(text):
            return [*spans, (start, end)]
        end = last_break(text, start, end)
        spans.append((start, end))
        if end >= len(text):
            break
        start = max(start + 1, end - rules.overlap_chars)
    return spans


def split_text(documents: DataFrame, rules: Chunking | None = None, *, text: str = "text") -> DataFrame:
    """One row per chunk that isn't blank: adds ordinal, span_start, span_end and chunk_text.

    Ordinals count blank chunks as well, so they may have gaps. White space and
    code points are Python's, hence a vectorised UDF for the spans alone.
    """
    rules = rules or Chunking()

    @F.pandas_udf("array<struct<ordinal int, span_start int, span_end int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"ordinal": i, "span_start": a, "span_end": b} for i, (a, b) in enumerate(chunk_spans(t, rules)) if t[a:b].strip()] for t in texts], dtype=object)

    out = spread(documents).withColumn("_span", F.explode(spans(F.col(text))))
    piece = F.substring(F.col(text), F.col("_span.span_start") + 1, F.col("_span.span_end") - F.col("_span.span_start"))
    return out.select("*", "_span.*", piece.alias("chunk_text")).drop("_span")


def spread(documents: DataFrame) -> DataFrame:
    """The rows over all cores, if fewer have rows or one has over twice its share: a row group is one task, however dear the work and however many parts its file is cut into."""
    if documents.isStreaming:
        return documents
    cores = documents.sparkSession.sparkContext.defaultParallelism
    rows = [r[0] for r in documents.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    even = len(rows) >= cores and max(rows) * cores <= 2 * sum(rows)
    return documents if even else documents.repartition(max(cores, documents.rdd.getNumPartitions()))


def _c(of: Column | str) -> Column:
    return F.col(of) if isinstance(of, str) else of


def feature_words(text: Column | str) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def word_pairs(words: Column) -> Column:
    """Neighbouring words, joined by a blank."""
    later = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), later, lambda a, b: F.concat(a, F.lit(" "), b))


def char_trigrams(words: Column) -> Column:
    """Trigrams of each word with a blank on either side, marked by #."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.lit("#"), F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3))))
    return F.flatten(F.transform(words, grams))


def ngram_features(text: Column | str) -> Column:
    """Words, word pairs and character trigrams, repeats included."""
    words = feature_words(text)
    return F.concat(words, word_pairs(words), char_trigrams(words))


#: Texts that are counted together: at most so many, and of so many bytes but for a longer one alone.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 1024, 4 << 20


def _of_texts(documents: DataFrame, key: str, text: str, made: str, make: Callable[[list[str | None]], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """(key, columns ``made``): what ``make`` gives of some texts at a time, with the number of its text for each row. Nothing is shuffled but to spread the rows."""
    shape = T.StructType([documents.schema[key], *T.StructType.fromDDL(made).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            start, held = 0, 0
            for at, length in enumerate([*lengths, BYTES_AT_ONCE + 1]):
                if at > start and (held + length > BYTES_AT_ONCE or at - start >= TEXTS_AT_ONCE):
                    part = batch.slice(start, at - start)
                    of, columns = make(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *columns], shape.names)
                    start, held = at, 0
                held += length

    return spread(documents.select(key, F.col(text).alias("_text" if key != "_text" else "_text_"))).mapInArrow(run, shape)


def counted(documents: DataFrame, key: str, kind: str, *, text: str = "text") -> DataFrame:
    """(key, feature, n): how often a row has each of its features of a ``kind``: words, pairs or trigrams (see `ngram_features`)."""
    if kind not in ("words", "pairs", "trigrams"):
        raise ValueError(f"unknown kind of features: {kind}")

    def make(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        words, ids = _word_ids(texts)
        n, names = max(len(words), 1), pa.array(words, pa.string())
        if kind == "pairs":
            of = np.repeat(np.arange(len(ids)), [max(0, len(i) - 1) for i in ids])
            met, times = np.unique(of * (n * n) + _pairs(ids, n), return_counts=True)
            of, pair = np.divmod(met, n * n)
            features = pc.binary_join_element_wise(names.take(pa.array(pair // n)), names.take(pa.array(pair % n)), " ")
        else:
            of, word, times = _met(ids, n)
            features = names.take(pa.array(word))
        if kind == "trigrams":
            known: dict[str, int] = {}
            own = [[known.setdefault(g, len(known)) for g in _trigrams(w)] for w in words]
            many, at = _each(np.array([len(o) for o in own], np.int64), word)
            grams, g = np.array([x for o in own for x in o], np.int64)[at], max(len(known), 1)
            met, place = np.unique(np.repeat(of, many) * g + grams, return_inverse=True)
            times = np.bincount(place, weights=np.repeat(times, many), minlength=len(met)).astype(np.int64)
            of, features = met // g, pa.array(list(known), pa.string()).take(pa.array(met % g))
        return of, [features, pa.array(times, pa.int64())]

    return _of_texts(documents, key, text, "feature string, n long", make)


def _word_ids(texts: Sequence[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of some texts, and each text as their numbers."""
    known: dict[str, int] = {}
    ids = [np.array([known.setdefault(w, len(known)) for w in _WORD.findall((t or "").lower())], np.int64) for t in texts]
    return list(known), ids


def _met(ids: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and how often, for each distinct word of each text."""
    of = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    met, times = np.unique(of * n + np.concatenate([np.zeros(0, np.int64), *ids]), return_counts=True)
    return met // n, met % n, times


def _pairs(ids: list[np.ndarray], n: int) -> np.ndarray:
    """Neighbouring words of each text: the first's number times ``n`` plus the second's."""
    return np.concatenate([np.zeros(0, np.int64), *(i[:-1] * n + i[1:] for i in ids)])


def _each(sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many features of its own each of the words has, and the places of them all; ``sizes``: of the distinct words, one after the other."""
    starts, many = np.cumsum(sizes) - sizes, sizes[word]
    return many, np.repeat(starts[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [f"#{padded[i : i + 3]}" for i in range(len(word))]


def hashed_features(documents: DataFrame, key: str, dimension: int, *, text: str = "text") -> DataFrame:
    """(key, bucket, value): signed counts of the hashed features; buckets of sum 0 included."""

    def make(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        plus, minus = _hashed_counts(texts, dimension)
        of, bucket = np.nonzero(plus + minus)
        return of, [pa.array(bucket, pa.int64()), pa.array((plus - minus)[of, bucket].astype(np.int64))]

    return _of_texts(documents, key, text, "bucket long, value long", make)


def embed_texts(texts: Sequence[str | None], dimension: int) -> np.ndarray:
    """The unit vectors (float32) of the texts' hashed features, one a row; zeros for a text that has none."""
    plus, minus = _hashed_counts(texts, dimension)
    out = plus - minus
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(length == 0, 1.0, length)).astype(np.float32)


def _hashed_counts(texts: Sequence[str | None], dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """How many features of either sign each text has in each bucket.

    Of the texts together, every word and every pair of words is hashed once;
    the rest are sums over (text, word) and (text, pair).
    """
    words, ids = _word_ids(texts)
    n = max(len(words), 1)
    # The features of a word alone: itself and its trigrams.
    own = [[w, *_trigrams(w)] for w in words]
    text, word, times = _met(ids, n)
    many, at = _each(np.array([len(f) for f in own], np.int64), word)
    hashes = _hashed(f for x in own for f in x)[at]
    out = _by_sign(np.repeat(text, many), hashes, np.repeat(times, many), len(ids), dimension)
    later = _pairs(ids, n)
    pairs, place = np.unique(later, return_inverse=True)
    hashes = _hashed(f"{words[x // n]} {words[x % n]}" for x in pairs.tolist())[place]
    of_pairs = _by_sign(np.repeat(np.arange(len(ids)), [max(0, len(i) - 1) for i in ids]), hashes, np.ones(len(later)), len(ids), dimension)
    return out[0] + of_pairs[0], out[1] + of_pairs[1]


def _hashed(features: Iterable[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(f.encode()) for f in features), np.int64)


def _by_sign(text: np.ndarray, hashes: np.ndarray, times: np.ndarray, rows: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    place = (text * dimension + hashes % dimension) * 2 + (hashes >> 31)
    both = np.bincount(place, weights=times, minlength=rows * dimension * 2).reshape(rows, dimension, 2)
    return both[:, :, 1], both[:, :, 0]


def embed_text(text: str | None, dimension: int) -> np.ndarray:
    return embed_texts([text], dimension)[0]


def local_embeddings(documents: DataFrame, key: str, dimension: int, *, text: str = "text") -> DataFrame:
    """(key, vector array<float>): the features of `hashed_features` as unit vectors, one row per row.

    Made in the tasks, because the dense vector of a text needs nothing from
    other rows: the native form would shuffle every feature.
    """

    def make(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        made = embed_texts(texts, dimension)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * dimension
        return np.arange(len(texts)), [pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()))]

    return _of_texts(documents, key, text, "vector array<float>", make)


def content_hash(text: Column | str) -> Column:
    return F.sha2(F.coalesce(_c(text), F.lit("")), 256)


def redact(text: Column | str) -> Column:
    """Token-shaped strings become [REDACTED]. Exact secrets are removed on the driver only: see service.identity."""
    out = _c(text)
    for shape, instead in SECRETS:
        out = F.regexp_replace(out, shape, instead)
    return out
