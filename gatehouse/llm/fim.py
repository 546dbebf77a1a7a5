"""Fill-in-middle transformation: a parallel automaton scan finds the cuts, however long a text is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialise, name, utf8_rows

#: Marks before the parts of a transformed text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a text from which on it is dealt to tasks in chunks, and bytes of a chunk.
GIANT, CHUNK = 1 << 16, 1 << 15
#: Bytes that the lowest level of a scan takes at once, by a table.
GROUP = 5
#: States: inside a word or not, times how much of a mark was just seen (3: a whole one, anywhere before).
STATES, START, _MARKED = 8, 0, 3
#: Classes of bytes: blank, the three characters of a mark, other; the last one stands for no byte.
_BLANK, _OPEN, _LETTER, _CLOSE, _OTHER, _NONE = range(6)


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of a byte, next state, whether a token ends before the byte), the last two by state and class."""
    classes = np.full(256, _OTHER, np.uint8)
    classes[[9, 10, 11, 12, 13, 32]] = _BLANK
    classes[ord("<")], classes[ord(">")], classes[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = _OPEN, _CLOSE, _LETTER
    to, ends = np.zeros((STATES, _NONE + 1), np.uint8), np.zeros((STATES, _NONE + 1), np.int64)
    for state in range(STATES):
        word, mark = divmod(state, 4)
        for c in range(_NONE):
            seen = _MARKED if mark == _MARKED or (mark == 2 and c == _CLOSE) else 1 if c == _OPEN else 2 if mark == 1 and c == _LETTER else 0
            to[state, c] = 4 * (c != _BLANK) + seen
            ends[state, c] = word and c == _BLANK
        to[state, _NONE] = state
    return classes, to, ends


CLASSES, NEXT, ENDS = _automaton()


def _group_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every GROUP of classes: the state that each state is led to, and the tokens that end on the way."""
    to, ends = np.arange(STATES, dtype=np.uint8)[None], np.zeros((1, STATES), np.int64)
    for _ in range(GROUP):
        ends = (ends[:, None] + ENDS[to].transpose(0, 2, 1)).reshape(-1, STATES)
        to = NEXT[to].transpose(0, 2, 1).reshape(-1, STATES)
    return to, ends.astype(np.int32)


_GROUP_NEXT, _GROUP_ENDS = _group_tables()


class Scan:
    """A piece of a text (UTF-8) as a function of states, and the tree of functions that it is composed of.

    Every node has, for each state in which its bytes may be entered, the state
    in which they are left and how many tokens end in them. A node is composed
    of its two children; composition is associative, so pieces of a text can be
    scanned anywhere, in any order, before it is known in which state they begin.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        groups = -(-len(data) // GROUP)
        classes = np.full(groups * GROUP, _NONE, np.uint16)
        classes[: len(data)] = CLASSES[data]
        codes = classes[::GROUP].astype(np.intp)
        for i in range(1, GROUP):
            codes = codes * (_NONE + 1) + classes[i::GROUP]
        self.levels = [(_GROUP_NEXT[codes], _GROUP_ENDS[codes])]
        while len(self.levels[-1][0]) > 1:
            to, ends = self.levels[-1]
            n = len(to) // 2
            at = (to[0 : 2 * n : 2] + STATES * np.arange(n)[:, None]).ravel()
            above = to[1 : 2 * n : 2].ravel().take(at).reshape(n, STATES), ends[0 : 2 * n : 2] + ends[1 : 2 * n : 2].ravel().take(at).reshape(n, STATES)
            # An odd one at the end goes up as it is.
            self.levels.append(tuple(np.concatenate([a, x[2 * n :]]) for a, x in zip(above, (to, ends), strict=True)))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """(state that each state is led to, tokens that end from each state on)."""
        if not len(self.data):
            return np.arange(STATES, dtype=np.uint8), np.zeros(STATES, np.int64)
        return self.levels[-1][0][0], self.levels[-1][1][0]

    def end_of(self, state: int, k: int) -> int:
        """Place of the byte before which the k-th token ends (k from 1), if the piece is entered in this state."""
        at = 0
        for to, ends in self.levels[-2::-1]:
            at *= 2
            here = int(ends[at, state])
            if k > here:
                k, state, at = k - here, int(to[at, state]), at + 1
        for place in range(at * GROUP, len(self.data)):
            c = CLASSES[self.data[place]]
            k -= int(ENDS[state, c])
            if k == 0:
                return place
            state = int(NEXT[state, c])
        raise ValueError("fewer tokens end here")


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def cut(data: np.ndarray, h1: int, h2: int) -> tuple[int, bool, int, int]:
    """(tokens, whether there is a mark, characters before the first and before the second cut) of a text."""
    if not len(data):
        return 0, False, 0, 0
    scan = Scan(data)
    to, ends = scan.whole()
    n = int(ends[START]) + 1  # the last one ends with the text
    places = [0 if k == 0 else len(data) if k == n else scan.end_of(START, k) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    return n, to[START] % 4 == _MARKED, *[characters(data[:p]) for p in places]


_CUT = "struct<n long, marked boolean, first long, second long>"


def fim_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: str = "42", fim_percent: int = 50, spm_percent: int = 80, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Transform every document: doc_id, text, n, form, prefix_chars, middle_chars and output.

    Tokens are words with the ASCII white space before them, and white space at
    the end of a text; n counts them. Two cuts between tokens, and the form
    (plain, psm or spm), follow from hashes of ``seed`` and the id (a null id:
    nothing). An empty text and one that holds a mark stay plain. A null text
    is empty; repeated rows are transformed alike; other columns don't matter.
    The empty table gives the empty table.

    Texts of up to ``giant`` bytes are scanned where they lie. Longer ones are
    dealt out in chunks, which are scanned anywhere (see `giant_cuts`).
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name(doc_id).cast("string"), F.lit(""))), 256)
    rows = docs.select(name(doc_id).alias("doc_id"), F.coalesce(name(text), F.lit("")).alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = rows.select("doc_id", "text", *[c.alias(f"h{i + 1}") for i, c in enumerate(h)])

    @F.arrow_udf(_CUT)
    def in_place(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            found = [cut(data, a, b) for data, a, b in zip(utf8_rows(texts), first.to_pylist(), second.to_pylist(), strict=True)]
            n, marked, one, two = zip(*found, strict=True) if found else ((),) * 4
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["n", "marked", "first", "second"])

    is_giant = F.octet_length("text") > giant
    small = rows.where(~is_giant).withColumn("cut", in_place("text", "h1", "h2"))
    # What the cuts depend on is the key, so repeated rows are one.
    key = F.sha2(F.concat("h1", F.lit(":"), "h2", F.lit(":"), F.sha2("text", 256)), 256)
    long = rows.where(is_giant).withColumn("key", key)
    cuts = giant_cuts(long.select("key", "text", "h1", "h2").dropDuplicates(["key"]), chunk)
    both = small.unionByName(long.join(cuts, "key").select(*rows.columns, F.struct("n", "marked", "first", "second").alias("cut")))

    plain = (F.length("text") == 0) | F.col("cut.marked") | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    formed = both.select("doc_id", "text", "cut.n", form.alias("form"), F.when(~plain, F.col("cut.first")).alias("prefix_chars"), F.when(~plain, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"))
    return formed.withColumn("output", _output())


def _output() -> Column:
    a, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, m), F.substring("text", a + m + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed document was made from, of its output and form alone.

    A transformed text holds no mark of its own, so the first mark of a kind is the one put in.
    """
    after = lambda c, mark: F.substring(c, F.instr(c, mark) + len(mark), F.length(c))
    before = lambda c, mark: F.substring_index(c, mark, 1)
    middle = after(output, MIDDLE)
    psm = F.concat(before(after(output, PREFIX), SUFFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, before(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def giant_cuts(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, n, marked, first, second) of texts of any length, scanned in chunks on all tasks.

    texts: key string (distinct), text, h1 and h2 long.

    1. Chunks are written; each becomes a function of states with the tokens
       that end in it from each state, and its code points.
    2. Of a text's functions alone (a few dozen bytes a chunk), in order,
       follow the state and the number of tokens before each chunk, and so
       which chunk has each cut, entered in which state.
    3. Those chunks are scanned again, to find the place of the cut in them.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), utf8_rows(batch.column("text")), strict=True):
                for at in range(0, len(data), 64 * chunk):
                    part = [data[i : i + chunk].tobytes() for i in range(at, min(at + 64 * chunk, len(data)), chunk)]
                    yield pa.RecordBatch.from_pydict({"key": [key] * len(part), "chunk": pa.array(range(at // chunk, at // chunk + len(part)), pa.int64()), "data": pa.array(part, pa.binary())})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"key": batch.column("key"), "chunk": batch.column("chunk"), "to": [], "ends": [], "chars": []}
            for piece in batch.column("data"):
                data = np.frombuffer(piece.as_buffer(), np.uint8)
                to, ends = Scan(data).whole()
                for c, v in (("to", to.tolist()), ("ends", ends.tolist()), ("chars", characters(data))):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([out["key"], out["chunk"], pa.array(out["to"], pa.list_(pa.int64())), pa.array(out["ends"], pa.list_(pa.int64())), pa.array(out["chars"], pa.int64())], list(out))

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        to, ends, chars = np.stack(rows["to"].to_numpy()), np.stack(rows["ends"].to_numpy()), np.concatenate([[0], np.cumsum(rows["chars"].to_numpy())])
        entered, ended, state = [], [0], START
        for f, c in zip(to, ends, strict=True):
            entered.append(state)
            ended.append(ended[-1] + int(c[state]))
            state = int(f[state])
        n = ended[-1] + 1
        out = []
        for which, k in enumerate(sorted(int(h) % (n + 1) for h in rows[["h1", "h2"]].iloc[0])):
            at = int(np.searchsorted(ended, k, side="left")) - 1 if 0 < k < n else -1
            known = (0 if k == 0 else int(chars[-1])) if at < 0 else int(chars[at])
            out.append((rows["key"].iloc[0], which, n, state % 4 == _MARKED, at, entered[at] if at >= 0 else 0, k - ended[at] if at >= 0 else 0, known))
        return pd.DataFrame(out, columns=["key", "which", "n", "marked", "chunk", "state", "k", "chars"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [0 if data is None else characters(d[: Scan(d).end_of(state, k)]) for data, state, k in zip(batch.column("data").to_pylist(), batch.column("state").to_pylist(), batch.column("k").to_pylist(), strict=True) for d in [np.frombuffer(data or b"", np.uint8)]]
            kept = [batch.column(c) for c in ("key", "which", "n", "marked")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([a + b for a, b in zip(batch.column("chars").to_pylist(), more, strict=True)], pa.int64())], ["key", "which", "n", "marked", "chars"])

    tasks = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = materialise(texts)
    pieces = materialise(texts.select("key", "text").mapInArrow(chunks, "key string, chunk long, data binary").repartition(tasks, "key", "chunk"))
    functions = pieces.mapInArrow(scan, "key string, chunk long, to array<long>, ends array<long>, chars long").join(texts.select("key", "h1", "h2"), "key")
    wanted = functions.groupBy("key").applyInPandas(resolve, "key string, which int, n long, marked boolean, chunk long, state int, k long, chars long")
    found = wanted.join(pieces, ["key", "chunk"], "left").mapInArrow(select, "key string, which int, n long, marked boolean, chars long")
    at = lambda which: F.max(F.when(F.col("which") == which, F.col("chars")))
    return materialise(found.groupBy("key").agg(F.max("n").alias("n"), F.max("marked").alias("marked"), at(0).alias("first"), at(1).alias("second")))
