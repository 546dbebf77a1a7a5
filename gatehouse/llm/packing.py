"""Packing token sequences: best fit, then swap-based local search."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import held, materialise, name, small_batches

#: Documents that one task packs together, about. A task leaves at most a few sequences half empty.
DOCS_A_TASK = 40_000
#: Bytes of pieces and ids that a memory holds before it starts anew, and those of the longest piece that is remembered.
REMEMBERED, LONGEST = 24 << 20, 256


class _Known(dict):
    """Piece -> its ids as bytes, filled when asked. When it is full, what wasn't asked since it last was goes."""

    def __init__(self, encode: Callable[[str], list[int]], before: str):
        super().__init__()
        self.encode, self.before, self.older, self.held = encode, before, {}, 0

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return array("I", self.encode(self.before + piece)).tobytes()
        if self.held >= REMEMBERED:
            self.older, self.held = dict(self), 0
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.encode(self.before + piece)).tobytes()
        self[piece] = ids
        # What Python adds to a string and to bytes, and a dictionary to either, is about 200 bytes.
        self.held += 4 * len(piece) + len(ids) + 200
        return ids


class WordTokenizer:
    """Ids of whole texts by a byte-level BPE vocabulary, word by word.

    The pattern that parts a text before byte pairs are merged never joins what
    stands before a single blank between two other characters with what
    follows. So the ids of a text are those of its pieces between such blanks
    (each with its blank), and as pieces recur, most are looked up. ``encode``
    gives the ids of any string, as of ordinary text. ``added`` has the tokens
    that part a text before all else (of several that match, the longest), with
    their ids; what stands between two of them is a text of its own.
    """

    def __init__(self, encode: Callable[[str], list[int]], added: dict[str, int] | None = None):
        self.first, self.later = _Known(encode, ""), _Known(encode, " ")
        self.added = {token: array("I", [i]).tobytes() for token, i in (added or {}).items()}
        self.parting = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    @classmethod
    def from_ranks(cls, path: str, pattern: str, added: dict[str, int] | None = None) -> WordTokenizer:
        """From a vocabulary file of lines (base64 of a token's bytes, rank)."""
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks_of = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            ids, at = [], 0
            for blank in _LONG_BLANK.finditer(text):
                # All but the last character, which may belong to what follows, are one piece of the pattern.
                end = blank.end() - (blank.end() < len(text))
                ids += ranks_of.encode_ordinary(text[at : blank.start()])
                ids += ranks_of._encode_single_piece(text[blank.start() : end])
                at = end
            return ids + ranks_of.encode_ordinary(text[at:])

        return cls(encode, added)

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if not any(token in text for token in self.added):
            return self._ordinary(text)
        # The tokens stand at the odd places.
        return b"".join(self.added[part] if k % 2 else self._ordinary(part) for k, part in enumerate(self.parting.split(text)))

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        first, *later = text.split(" ") if _plain(text) else _pieces(text)
        known = self.later
        return self.first[first] + b"".join([known[p] for p in later])


def added_tokens(path: str) -> dict[str, int]:
    """Added token -> id, of a JSON file of `tokenizers`. They have to be plain: found anywhere in a text as it is."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens", [])
    for t in tokens:
        if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {t['content']!r} is matched in a way that isn't supported")
    return {t["content"]: t["id"] for t in tokens}


#: White space so long that the pattern's search, which backtracks over it, is left out.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_OTHER_SPACE = [chr(c) for c in range(0x110000) if chr(c).isspace() and c != 32]


def _plain(text: str) -> bool:
    """Whether every blank stands between two characters that aren't white space."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return False
    return not any(c in text and (c + " " in text or " " + c in text) for c in _OTHER_SPACE)


def _pieces(text: str) -> list[str]:
    """Pieces of a text that has blanks next to other white space: those blanks don't part it."""
    words = text.split(" ")
    out, piece = [], [words[0]]
    for before, word in zip(words, words[1:], strict=False):
        if before and word and not before[-1].isspace() and not word[0].isspace():
            out.append(" ".join(piece))
            piece = []
        piece.append(word)
    return [*out, " ".join(piece)]


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Best fit, largest first: bins of item numbers."""
    bins: list[list[int]] = []
    open_: list[tuple[int, int]] = []  # (free, bin), ordered
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(open_, (sizes[i], -1))
        if at == len(open_):
            free, b = room, len(bins)
            bins.append([])
        else:
            free, b = open_.pop(at)
        bins[b].append(i)
        if free > sizes[i]:
            insort(open_, (free - sizes[i], b))
    return bins


def needed(sizes: list[int], room: int) -> int:
    """A number of bins that any packing needs at least (Martello and Toth's second bound).

    Items of over half the room need a bin each, and of the smaller ones, from
    some size on, those that don't fit beside them need more.
    """
    order = np.sort(np.array(sizes, np.int64))
    sums = np.concatenate([[0], np.cumsum(order)])
    half = int(np.searchsorted(order, room // 2, side="right"))
    best = len(order) - half
    for least in np.unique(order[:half]).tolist():
        low, alone = int(np.searchsorted(order, least)), int(np.searchsorted(order, room - least, side="right"))
        alone = max(alone, half)
        beside = room * (alone - half) - int(sums[alone] - sums[half])
        best = max(best, len(order) - half + max(0, -(-(int(sums[half] - sums[low]) - beside) // room)))
    return best


def improve(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Swap-based local search over the bins that aren't full.

    The emptiest bins give, the fuller ones take: for a taker with free space
    f, in this order of what it gains, a document moves over (gain = its size),
    one is exchanged for a larger one, or one for two. Each step takes the
    largest gain up to f and makes the taker fuller than it was and the giver
    emptier, so the sum of squared fills rises; a giver that is empty goes. It
    ends when no taker gains from any emptier bin.
    """
    fill = {b: sum(sizes[i] for i in items) for b, items in enumerate(bins)}
    slack = {b for b in fill if fill[b] < room}
    if len(slack) < 2 or sum(fill[b] for b in slack) > room * (len(slack) - 1):
        return bins  # even a perfect packing of these bins needs as many
    if needed([sizes[i] for b in slack for i in bins[b]], room) >= len(slack):
        return bins  # these can't do with fewer
    home = {i: b for b in slack for i in bins[b]}
    # By size, the items of bins with slack, those in the emptiest bin first; and the bins. What has changed since it was put in goes when it is met.
    where: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for i, b in home.items():
        where[sizes[i]].append((fill[b], b, i))
    for heap in where.values():
        heapify(heap)
    emptiest = [(fill[b], b) for b in slack]
    heapify(emptiest)
    present = sorted(where)

    def giver(size: int, taker: int) -> tuple[int, int] | None:
        """An item of this size in the emptiest bin that is emptier than the taker."""
        heap = where[size]
        while heap and (heap[0][1] not in slack or home[heap[0][2]] != heap[0][1] or fill[heap[0][1]] != heap[0][0]):
            heappop(heap)
        return heap[0][1:] if heap and heap[0][1] != taker and heap[0][:2] < (fill[taker], taker) else None

    def least() -> int | None:
        """The emptiest bin."""
        while emptiest and (emptiest[0][1] not in slack or fill[emptiest[0][1]] != emptiest[0][0]):
            heappop(emptiest)
        return emptiest[0][1] if emptiest else None

    def put(i: int, a: int, b: int) -> None:
        bins[a].remove(i)
        bins[b].append(i)
        home[i] = b
        fill[a] -= sizes[i]
        fill[b] += sizes[i]

    def step(b: int) -> bool:
        free = room - fill[b]
        best: tuple[int, list[tuple[int, int]], list[int]] = (0, [], [])  # gain, what comes, what goes
        for at in range(bisect_left(present, free + 1) - 1, -1, -1):
            if found := giver(present[at], b):
                best = (present[at], [found], [])
                break
        for j in sorted(set(bins[b]), key=lambda j: sizes[j]):
            if best[0] == free:
                break
            for at in range(bisect_left(present, sizes[j] + free + 1) - 1, -1, -1):
                gain = present[at] - sizes[j]
                if gain <= best[0]:
                    break
                if (found := giver(present[at], b)) and fill[found[0]] - gain < fill[b]:
                    best = (gain, [found], [j])
                    break
        if best[0] < free:
            # Two of the emptiest bin for one of this one.
            a = least()
            if a is not None and a != b and (fill[a], a) < (fill[b], b):
                own = sorted(bins[a], key=lambda i: sizes[i])
                for j in bins[b]:
                    lo, hi, most = 0, len(own) - 1, sizes[j] + free
                    while lo < hi and best[0] < free:
                        two = sizes[own[lo]] + sizes[own[hi]]
                        if two > most:
                            hi -= 1
                            continue
                        if two - sizes[j] > best[0]:
                            best = (two - sizes[j], [(a, own[lo]), (a, own[hi])], [j])
                        lo += 1
        if not best[0]:
            return False
        a = best[1][0][0]
        for _, i in best[1]:
            put(i, a, b)
        for j in best[2]:
            put(j, b, a)
        for x in (a, b):
            if fill[x] in (0, room):
                slack.discard(x)
                continue
            heappush(emptiest, (fill[x], x))
            for i in bins[x]:
                heappush(where[sizes[i]], (fill[x], x, i))
        return True

    moved = True
    while moved and len(slack) > 1:
        moved = False
        for b in sorted(slack, key=lambda b: (-fill[b], b)):
            while b in slack and step(b):
                moved = True
    return [items for items in bins if items]


def cut(length: int, room: int) -> list[int]:
    """Lengths of a document's pieces: all ``room`` long but the first, which takes what is over."""
    whole, first = divmod(length, room)
    return [first] * (first > 0) + [room] * whole


def pack_documents(docs: DataFrame, load: Callable[[], WordTokenizer], *, text: str = "text", doc_id: str = "doc_id", room: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``room`` tokens, one row per piece.

    Returns doc_id, piece (from 0), start, length, ids_crc32 (of the piece's
    ids as little-endian unsigned 32-bit numbers), sequence_id and offset, and
    with ``keep_ids`` the ids (binary). A null text is empty; every document
    ends with ``end_id``, so it has at least one token. Only documents longer
    than ``room`` are cut. Repeated rows are packed as documents of their own.
    The empty table gives the empty table.

    Texts are encoded where they lie, in batches of a few MB, and their pieces
    written. Pieces of ``room`` tokens are sequences of their own and stay where
    they are. The others, at most one of each document, are dealt evenly,
    whatever their ids, to tasks of about DOCS_A_TASK, each of which packs its
    own by best fit and local search. So a task's memory depends neither on the
    number nor on the length of the documents. A task wastes at most
    what its last few sequences have free, so the waste falls with the size of
    the tasks and not with the size of the input. ``load`` makes the tokenizer
    on an executor.
    """
    id_type = docs.schema[doc_id].dataType
    # Whole numbers travel as text: in pandas, a null among them makes them floats.
    travels = T.StringType() if isinstance(id_type, T.IntegralType) else id_type
    pieces = f"doc_id {travels.simpleString()}, piece int, start long, length long, ids_crc32 long"
    if keep_ids:
        pieces += ", ids binary"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, end = held("tokenizer", load, load), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                rows = []
                for d, text in zip(part["doc_id"], part["text"], strict=True):
                    ids = tokenizer.ids(text) + end
                    start = 0
                    for k, n in enumerate(cut(len(ids) // 4, room)):
                        own = ids[4 * start : 4 * (start + n)]
                        rows.append((d, k, start, n, zlib.crc32(own), own)[: 5 + keep_ids])
                        start += n
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])
                yield out

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        # A fixed order, so that a task that is run again numbers its sequences alike.
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32", "length"], kind="stable", ignore_index=True, na_position="last")
        own = rows["length"].tolist()
        bins = improve(best_fit(own, room), own, room)
        sequence, offset = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = k, at
                at += own[i]
        rows["sequence_id"] = sequence + (TaskContext.get().partitionId() << 36)
        rows["offset"] = offset
        yield rows

    slim = docs.select(name(doc_id).cast(travels).alias("doc_id"), name(text).alias("text"))
    with small_batches(docs.sparkSession):
        encoded = materialise(slim.mapInPandas(encode, pieces))
    short, full = encoded.where(F.col("length") < room), encoded.where(F.col("length") == room)
    tasks = max(1, -(-short.count() // DOCS_A_TASK))
    packed = short.repartition(tasks).mapInPandas(pack, f"{pieces}, sequence_id long, offset long")
    # Far above the numbers of the packed ones.
    alone = full.select("*", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = packed.unionByName(alone)
    return packed.withColumn("doc_id", F.col("doc_id").cast(id_type))
