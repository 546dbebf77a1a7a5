"""Language identification by cross-parsing entropy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import boxed, held, name, small_table

#: What a text without a letter, or any text where nothing was learned, is called.
UNKNOWN = "und"
#: Bounds of the labelled sample: characters a language, all together, of one text.
CHARS, ALL_CHARS, TEXT_CHARS = 40_000, 1_000_000, 20_000
#: What each language gets of them at least, and how many there may be.
LEAST_CHARS, MAX_LANGUAGES = 2_000, 5_000
#: Rows of a language that are fetched, at most, to fill its characters.
ROWS = 400
#: Characters of a language's sample up to which its automaton is a plain table; that of a larger script is hashed.
DENSE = 128
#: Characters of a window; windows are parsed side by side.
WINDOW = 512
#: Characters of texts that are parsed at once, about.
AT_ONCE = 1_000_000


class SuffixAutomaton:
    """All substrings of a text: (states, symbols) -> states, of whole arrays (0: none; 1: the start).

    Symbols are numbers from 1 to under ``width``; 0 is followed by nothing.
    Few symbols make a plain table of states by symbols; of many, the edges
    that exist, under three for each character, are kept in a hash table.
    """

    def __init__(self, symbols: np.ndarray, width: int):
        nexts: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in symbols.tolist():
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
            last = new
        self.width, self.table, self.keys = width, None, None
        keys = np.array([state * width + c for state, row in enumerate(nexts) for c in row], np.int64)
        to = np.array([x for row in nexts for x in row.values()], np.int32)
        if width <= DENSE:
            self.table = np.zeros(len(nexts) * width, np.int32)
            self.table[keys] = to
        else:
            self.bits = max(1, int(2 * len(keys)).bit_length())
            self.keys, self.table = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
            left, at = np.arange(len(keys)), self._slots(keys)
            while len(left):
                free = self.keys[at[left]] == -1
                _, first = np.unique(at[left], return_index=True)
                won = left[first[free[first]]]
                self.keys[at[won]], self.table[at[won]] = keys[won], to[won]
                left = np.setdiff1d(left, won, assume_unique=True)
                at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        # Multiplication by an odd number near 2^64 over the golden ratio (fixed value); the upper bits are the slot.
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        keys = states.astype(np.int64) * self.width + symbols
        if self.keys is None:
            return self.table[keys]
        to, at, left = np.zeros(len(keys), np.int32), self._slots(keys), np.arange(len(keys))
        while len(left):
            found = self.keys[at]
            hit = found == keys[left]
            to[left[hit]] = self.table[at[hit]]
            go = ~hit & (found != -1)
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return to


class CrossParser:
    """One automaton a language; counts the phrases that cover a text greedily.

    A phrase is the longest match that the automaton has from where the last
    one ended (one character, if none). A language's phrases are weighed by the
    logarithm of its sample's length, which makes them an estimate of the cross
    entropy; the language that needs fewest wins, of equal ones the first by name.
    """

    def __init__(self, samples: dict[str, str]):
        self.samples, self.languages = samples, sorted(samples)
        folded = {k: fold(samples[k]) for k in self.languages}
        # Characters of any sample are numbered once, and again among those of each language.
        known = np.unique(np.concatenate([np.zeros(0, np.uint32), *folded.values()]))
        # In as few bytes as they need, as texts are held in them.
        self.symbols = np.zeros(0x110000, np.min_scalar_type(len(known)))
        self.symbols[known] = np.arange(1, len(known) + 1)
        self.own, self.automata, self.weights = [], [], []
        for k in self.languages:
            mine = np.unique(self.symbols[folded[k]])
            own = np.zeros(len(known) + 1, np.int32)
            own[mine] = np.arange(1, len(mine) + 1)
            self.own.append(own)
            self.automata.append(SuffixAutomaton(own[self.symbols[folded[k]]], len(mine) + 1))
            self.weights.append(np.log2(max(2, len(folded[k]))))

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """lanes: symbols, one window a row, ordered by falling length; gives (language, window)."""
        steps = np.ascontiguousarray(lanes.T)
        live = [int(np.searchsorted(-lengths, -i, side="left")) for i in range(steps.shape[0])]
        out = np.zeros((len(self.automata), len(lengths)), np.int64)
        for k, (automaton, own) in enumerate(zip(self.automata, self.own, strict=True)):
            # State 0 has no way on, so the first character, and one after a
            # character that nothing matches, start a phrase like any other.
            state, n = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
            start = automaton.follow(np.ones(automaton.width, np.int32), np.arange(automaton.width, dtype=np.int32))
            for m, symbols in zip(live, steps, strict=True):
                c = own[symbols[:m]]
                to = automaton.follow(state[:m], c)
                ended = np.flatnonzero(to == 0)
                n[ended] += 1
                to[ended] = start[c[ended]]
                state[:m] = to
            out[k] = n
        return out

    def parse(self, texts: list[np.ndarray]) -> np.ndarray:
        """Weighted phrases per character, (text, language); texts are folded and not empty."""
        owner, pieces = [], []
        for i, codes in enumerate(texts):
            symbols = self.symbols[codes]
            for at in range(0, len(symbols), WINDOW):
                owner.append(i)
                pieces.append(symbols[at : at + WINDOW])
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(-lengths, kind="stable")
        totals = np.zeros((len(self.automata), len(texts)))
        for at in range(0, len(order), 8192):
            chosen = order[at : at + 8192]
            lanes = np.zeros((len(chosen), WINDOW), self.symbols.dtype)
            for row, j in enumerate(chosen):
                lanes[row, : lengths[j]] = pieces[j]
            found = self.phrases(lanes, lengths[chosen])
            for k in range(len(self.automata)):
                totals[k] += np.bincount(np.take(owner, chosen), weights=found[k], minlength=len(texts))
        return (totals * np.array(self.weights)[:, None] / np.array([len(t) for t in texts])).T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        at, some, chars = [], [], 0

        def flush() -> None:
            if some:
                for i, bits in zip(at, self.parse(some), strict=True):
                    best = int(bits.argmin())
                    langs[i], scores[i] = self.languages[best], float(1 / np.exp2(np.clip(bits[best] - bits, -60, 0) * SHARPNESS).sum())
            at.clear()
            some.clear()

        for i, text in enumerate(texts):
            codes = fold(text or "")
            if _LETTERS[codes].any():
                at.append(i)
                some.append(codes)
                chars += len(codes)
                if chars > AT_ONCE:
                    flush()
                    chars = 0
        flush()
        return langs, scores


#: How fast the score nears 1 with the lead, in bits per character, over the other languages.
SHARPNESS = 4.0
_BLANKS = np.zeros(0x110000, bool)
_BLANKS[[9, 10, 11, 12, 13, 32, 0xA0]] = True
_LETTERS = np.zeros(0x110000, bool)
for _c in range(0x110000):
    if unicodedata.category(chr(_c))[0] == "L":
        _LETTERS[_c] = True


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold(text: str) -> np.ndarray:
    """Code points in lower case; runs of white space and of digits become one blank or one 0."""
    codes = _codes(text.lower()).copy()
    codes[_BLANKS[codes]] = 32
    codes[(codes >= 48) & (codes <= 57)] = 48
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & ((codes[1:] == 32) | (codes[1:] == 48))
    return codes[~same]


def learn_languages(labelled: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", seed: int = 42) -> CrossParser:
    """Fit on a bounded sample of labelled rows.

    Of every language, about ROWS rows with the smallest seeded hashes of id
    and length are fetched, and their whole texts joined up to CHARS characters
    (ALL_CHARS over all languages, but LEAST_CHARS of each; more than
    MAX_LANGUAGES languages raise an error). Texts of over TEXT_CHARS characters aren't
    learned from, unless a language has no other.
    """
    usable = labelled.select(name(lang).alias("lang"), name(text).alias("text"), name(doc_id).alias("id")).where("lang IS NOT NULL AND length(text) > 0")
    usable = usable.withColumns({"u": F.pmod(F.xxhash64(F.lit(seed), "id", F.length("text")), F.lit(1 << 30)) / float(1 << 30), "long": F.length("text") > TEXT_CHARS})
    counts = usable.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return CrossParser({})
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    spark = labelled.sparkSession
    rows = [(r[0], r["short"] == 0, min(1.0, ROWS / max(1, r["short"] or r["n"]))) for r in counts]
    chosen = small_table(spark, rows, f"of {labelled.schema[lang].dataType.simpleString()}, any boolean, upto double")
    piece = F.substring("text", 1, TEXT_CHARS)
    sample = usable.join(F.broadcast(chosen), (F.col("lang") == F.col("of")) & (F.col("u") < F.col("upto")) & (F.col("any") | ~F.col("long")))
    budget = max(LEAST_CHARS, min(CHARS, ALL_CHARS // len(rows)))
    # A language has about ROWS rows here. No more leaves the executors than is learned from; a line break parts two texts.
    before = F.coalesce(F.sum(F.length("t") + 1).over(Window.partitionBy("lang").orderBy("u", "t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sample.select("u", "lang", piece.alias("t")).withColumn("before", before).where(F.col("before") < budget)
    cut = cut.select("u", "lang", F.substring("t", F.lit(1), (F.lit(budget) - F.col("before")).cast("int")).alias("t"), "before")
    texts: dict[str, list[str]] = {}
    for r in sorted(cut.collect(), key=lambda r: (r["lang"], r["before"])):
        texts.setdefault(r["lang"], []).append(r["t"])
    return CrossParser({k: "\n".join(v)[:budget] for k, v in texts.items()})


def identify_languages(docs: DataFrame, parser: CrossParser, *, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row, from its whole text.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing was learned. Otherwise the language is one that was learned.
    Columns of these names in the input are replaced.
    """
    # The samples are small; what is built from them is not, and each worker builds it once.
    shared = docs.sparkSession.sparkContext.broadcast(parser.samples)

    @F.pandas_udf("struct<lang string, score double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parser = held("languages", shared.value, lambda: CrossParser(shared.value))
            langs, scores = parser.predict(texts.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores})

    out = boxed(docs.drop("lang_pred", "score"), found=judge(name(text)))
    return out.select("row.*", F.col("found.lang").alias("lang_pred"), "found.score")
