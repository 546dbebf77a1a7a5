"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import held, small_table

#: Bounds of the labelled sample: rows of each label, and characters of a text that is learned from.
ROWS, TEXT_CHARS = 1_500, 50_000
#: Hashed n-gram vectors, their width, and the lengths of character n-grams.
BUCKETS, WIDTH, NGRAMS = 1 << 16, 8, (3, 4, 5)
EPOCHS, STEPS, RATE, DECAY, SLACK, SEED = 6, 300, 0.01, 1e-3, 1e-4, 7
#: Spread of the outputs at the start: a word of a long text has a small share of the mean, which they must scale up.
GAIN = 10.0
#: Parts of the sample that are kept back in turn (fewer, if a label has fewer texts), and quantiles that are tried as thresholds.
FOLDS, QUANTILES = 3, (0, 0.5, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
#: Texts of the sample in which a word must occur to be learned from.
LEAST_TEXTS = 3
#: Words whose score a task remembers, at most; twice: see _WordNumbers.
REMEMBERED = 200_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”„«»‘’–—"


def words(text: str | None) -> list[str]:
    """Lower-cased words without punctuation around them."""
    return [w for x in (text or "").lower().split() if (w := x.strip(_EDGES))]


def word_buckets(word: str) -> list[int]:
    """The word's own bucket and those of the character n-grams of <word>."""
    marked = f"<{word}>"
    grams = {marked}
    for n in NGRAMS:
        grams.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return sorted([zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams])


class _WordNumbers(dict):
    """Word -> mean number of its subwords, filled when asked. When it is full, what wasn't asked since it last was goes."""

    def __init__(self, numbers: list[float]):
        super().__init__()
        self.numbers, self.older = numbers, {}

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        known = self.older.get(word)
        if known is None:
            numbers, buckets = self.numbers, word_buckets(word)
            known = sum([numbers[b] for b in buckets]) / len(buckets)
        self[word] = known
        return known


class _Words:
    """The distinct words of texts as numbers, and the buckets of each word, in plain arrays."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        self.bags = [np.array([known.setdefault(w, len(known)) for w in sorted(set(words(t)))], np.int32) for t in texts]
        own = [np.array(word_buckets(w), np.int32) for w in known]
        self.sizes = np.array([len(g) for g in own], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.flat = np.concatenate([np.zeros(0, np.int32), *own])

    def buckets(self, ids: np.ndarray) -> np.ndarray:
        """The buckets of these words, one after the other."""
        sizes = self.sizes[ids]
        return self.flat[np.repeat(self.starts[ids] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]

    def scores(self, numbers: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Means over the texts' words of the means of their buckets' numbers."""
        of_word = np.add.reduceat(numbers[self.flat], self.starts[:-1]) / self.sizes if len(self.sizes) else np.zeros(0)
        return np.array([of_word[self.bags[i]].mean() if len(self.bags[i]) else 0.0 for i in texts])


def _softened(numbers: np.ndarray, quantile: float) -> np.ndarray:
    size = np.abs(numbers)
    used = size[size > 0]
    return np.sign(numbers) * np.maximum(0, size - (np.quantile(used, quantile) if quantile and len(used) else 0))


def _train(known: _Words, texts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's share of the difference of the two outputs: vectors times outputs, trained together.

    Small batches, Adam on vectors and outputs; labels weigh the same. SLACK
    keeps Adam from moving what few texts speak for as far as what many do.
    What no text has stays 0.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32)
    output = rng.normal(0, GAIN, (WIDTH, 2)).astype(np.float32)
    spread = np.bincount(np.concatenate([known.bags[i] for i in texts]), minlength=len(known.sizes))
    # A word of one or two texts tells these texts apart, and nothing else.
    docs = [known.bags[i][spread[known.bags[i]] >= LEAST_TEXTS] for i in texts]
    shares_of = [1 / max(1, len(known.bags[i])) for i in texts]
    weight = (len(target) / (2 * np.maximum(np.bincount(target, minlength=2), 1)))[target].astype(np.float32)
    params = [vectors, output, np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, touched = 0, np.zeros(BUCKETS, bool)
    epochs = max(EPOCHS, STEPS * 64 // len(docs))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            ids = np.concatenate([docs[i] for i in chosen])
            if len(ids) == 0:
                continue
            lengths = [len(docs[i]) for i in chosen]
            shares = np.repeat([shares_of[i] for i in chosen], lengths).astype(np.float32)
            rows = np.repeat(np.arange(len(chosen)), lengths)
            used, place = np.unique(ids, return_inverse=True)
            sizes = known.sizes[used]
            cells, cell = np.unique(known.buckets(used), return_inverse=True)
            touched[cells] = True
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            bag = np.add.reduceat(vectors[cells][cell], starts, axis=0) / sizes[:, None]
            mix = np.zeros((len(chosen), len(used)), np.float32)
            mix[rows, place] = shares
            hidden = mix @ bag
            logits = hidden @ output + params[2]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), target[chosen]] -= 1
            p *= weight[chosen, None] / len(chosen)
            g_bag = (mix.T @ (p @ output.T)) / sizes[:, None]
            g_flat = np.repeat(g_bag, sizes, axis=0)
            g_cells = np.stack([np.bincount(cell, weights=g_flat[:, d], minlength=len(cells)) for d in range(WIDTH)], axis=1).astype(np.float32)
            step += 1
            for k, (where, grad) in enumerate(((cells, g_cells), (slice(None), hidden.T @ p), (slice(None), p.sum(axis=0)))):
                first[k][where] = 0.9 * first[k][where] + 0.1 * grad
                second[k][where] = 0.99 * second[k][where] + 0.01 * grad * grad
                mean, square = first[k][where] / (1 - 0.9**step), second[k][where] / (1 - 0.99**step)
                params[k][where] -= rate * (mean / (np.sqrt(square) + (SLACK if k == 0 else 1e-8)) + DECAY * params[k][where] * (k < 2))
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float64) * touched


class Softmax:
    """p(label 1) = softmax over two linear outputs of the mean of the words' subword means.

    As the model is linear in the mean, a word's share of the two outputs'
    difference is one number; a text's score is the mean of its words' numbers.
    """

    def __init__(self) -> None:
        self.numbers, self.offset = np.zeros(BUCKETS), -4.0

    def fit(self, texts: list[str], labels: list[int], shares: tuple[float, float] | None = None) -> Softmax:
        """Learn from whole texts, in FOLDS parts: each is kept back once while vectors and outputs are trained together on the rest.

        The model's numbers are the mean of those of the parts. In between,
        small numbers, most of which are noise, are soft-thresholded: the
        threshold is the one that ranks the texts kept back best. Scale and offset are fitted to the scores that texts got while they were kept
        back. shares: how common the labels are outside the sample; by default
        as in the sample.
        """
        y = np.array(labels, np.int64)
        folds = int(min(FOLDS, *np.bincount(y, minlength=2))) if len(y) else 0
        if folds < 2:
            self.offset = 0.0 if not len(y) else 4.0 * np.sign(2 * np.mean(y) - 1)
            self.offset = self.offset or -4.0
            return self
        known = _Words(texts)
        fold = np.empty(len(y), np.int64)
        for label in (0, 1):
            of_label = np.flatnonzero(y == label)
            fold[of_label] = np.arange(len(of_label)) % folds
        trained = [_train(known, np.flatnonzero(fold != k), y[fold != k]) for k in range(folds)]
        best = None
        for quantile in QUANTILES:
            cut = [_softened(v, quantile) for v in trained]
            x, ranked = np.zeros(len(y)), 0.0
            for k in range(folds):
                own = x[fold == k] = known.scores(cut[k], np.flatnonzero(fold == k))
                ranks = np.argsort(np.argsort(own, kind="stable"), kind="stable")
                ranked += float(ranks[y[fold == k] == 1].mean() - ranks[y[fold == k] == 0].mean()) / len(own)
            if best is None or ranked > best[0]:
                best = ranked, np.mean(cut, axis=0), x, quantile
        # How well the texts kept back were ranked (area under the curve), and by which threshold, for reports.
        self.ranked, numbers, x, self.quantile = best[0] / folds + 0.5, *best[1:]
        target = np.array(shares or (np.mean(y == 0), np.mean(y == 1)))
        weight = (target / np.array([np.mean(y == 0), np.mean(y == 1)]))[y]
        spread = x.std() or 1.0
        z = np.stack([(x - x.mean()) / spread, np.ones(len(x))], axis=1)
        w = np.zeros(2)
        for _ in range(50):  # Newton steps with a slight pull to zero
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (weight * (y - p)) - 0.1 * w * (1, 0))
            w += np.clip(step, -2, 2)
        self.numbers = numbers * (w[0] / spread)
        self.offset = float(w[1] - w[0] * x.mean() / spread)
        return self

    def seen(self) -> _WordNumbers:
        """The memory of words' numbers, of the model that this process asked last."""
        return held("words", self, lambda: _WordNumbers(self.numbers.tolist()))

    def score(self, text: str | None) -> float:
        found = set(words(text))
        total = sum(map(self.seen().__getitem__, found)) / len(found) if found else 0.0
        return float(1 / (1 + np.exp(-np.clip(total + self.offset, -500, 500))))


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", seed: int = SEED) -> Softmax:
    """Fit on a bounded sample: of each label about ROWS ids with the smallest seeded hashes.

    The ids are chosen from the labels alone and, as they are few, broadcast to
    the documents, so no text is shuffled. Only labels 0 and 1 count, and texts
    of at most TEXT_CHARS characters; of a repeated id one row, and label 1
    if its labels differ. With one label alone, or none, the model gives every text that label's side (none: 0).
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y"), (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    upto = F.lit(0.0)
    for y, n in counts.items():
        upto = F.when(F.col("y") == y, min(1.0, ROWS / n)).otherwise(upto)
    chosen = known.where(F.col("u") < upto).groupBy("_id").agg(F.max("y").alias("y"), F.min("u").alias("u"))
    ids = small_table(spark, [tuple(r) for r in chosen.collect()], chosen.schema)
    texts = docs.where(F.length(text) <= TEXT_CHARS).select(F.col(doc_id).alias("_id"), F.col(text).alias("t"))
    found = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min_by(F.struct("t", "y", "u"), "t").alias("r")).select("r.*")
    sample = sorted(found.collect(), key=lambda r: (r["u"], r["t"], r["y"]))
    total = sum(counts.values()) or 1
    return Softmax().fit([r["t"] for r in sample], [r["y"] for r in sample], (counts.get(0, 0) / total, counts.get(1, 0) / total))


def score_toxicity(docs: DataFrame, model: Softmax, *, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5 on), from whole texts.

    A null text or one without words gets the model's bias alone. Repeated rows
    stay; columns of these names in the input are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    out = docs.drop("score", "predicted").withColumn("score", score(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
