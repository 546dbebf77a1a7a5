"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components, spanning_links
from ._spark import materialise, name

#: Leading principal dimensions of the grid and of boxes, vectors of the sample they are fitted on.
DIMS, SAMPLE = 16, 20_000
#: Vectors of a sequence interval, of one that isn't split further, and visitors of an interval that go to one task.
INTERVAL, LEAF, VISITORS = 4_096, 128, 131_072
#: Cells of the finer grid along an edge of the coarse one.
FINER = 4
#: Intervals and ranges of the order, at most: their boxes and counts are broadcast (under 300 bytes each).
#: Of more vectors than this many times INTERVAL, the intervals get longer.
MOST_INTERVALS = 65_536


def unit_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id long, x array<double>) for every row: x has length 1, or is null for a null, zero or non-finite vector."""
    x = F.transform(name(embedding), lambda v: v.cast("double"))
    rows = vectors.select(name(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    most = F.when(fine, F.array_max(F.transform("x", lambda v: F.abs(v))))
    # Divided by the largest component first, so that no square overflows.
    rows = rows.withColumn("_most", most).withColumn("x", F.when(F.col("_most") > 0, F.transform("x", lambda v: v / F.col("_most"))))
    rows = rows.withColumn("_norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))
    return rows.select("vec_id", F.transform("x", lambda v: v / F.col("_norm")).alias("x"))


def fit_axes(one: DataFrame, n: int, width: int, dims: int = DIMS, seed: int = 42) -> np.ndarray:
    """The leading principal axes of about SAMPLE of the ``n`` distinct vectors of this width, as rows; any orthonormal axes give right results."""
    share = min(1.0, SAMPLE / max(1, n))
    picked = one.where((F.size("x") == width) & (F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    x = np.array([r[0] for r in picked.select("x").limit(2 * SAMPLE).collect()])
    _, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and width > 1 else np.eye(width))
    return axes[:, ::-1][:, : min(dims, width)].T


def positions(xs: list[np.ndarray], axes: np.ndarray) -> np.ndarray:
    """Places in the grid: the width, which alone keeps vectors of different widths apart, then positions on the axes.

    Vectors of another width than the axes have their first components there.
    """
    at = np.zeros((len(xs), 1 + len(axes)))
    widths = np.array([len(x) for x in xs], np.int64)
    at[:, 0] = widths
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        x = np.stack([xs[i] for i in rows])
        x = x @ axes.T if width == axes.shape[1] else x[:, : len(axes)]
        at[rows, 1 : 1 + x.shape[1]] = x
    return at


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Least distance of two boxes (or of arrays of them) in the principal dimensions."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return np.sqrt((gap * gap).sum(axis=-1))


class Interval:
    """A stretch of the grid order: ids, unit vectors of one width, positions in the grid."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.copies = rows["vec_id"].to_numpy(), rows["copies"].to_numpy()
        self.x, self.at = np.stack(rows["x"].to_numpy()), np.stack(rows["at"].to_numpy())
        self.jumps = np.square(np.diff(self.at, axis=0)).sum(axis=1)

    def middle(self, lo: int, hi: int) -> int:
        """Where to cut a stretch: at the widest jump in its middle half, so that what lies close together stays together."""
        quarter = (hi - lo) // 4
        return lo + quarter + 1 + int(self.jumps[lo + quarter : hi - quarter - 1].argmax())

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at[lo:hi].min(axis=0), self.at[lo:hi].max(axis=0)


def in_order(rows: pd.DataFrame, edge: float) -> list[Interval]:
    """The rows in grid order, in each cell in the order of a finer grid, one stretch for each width."""
    at = np.stack(rows["at"].to_numpy())
    order = np.lexsort((rows["vec_id"].to_numpy(), *np.floor(at / edge * FINER).T[::-1], *np.floor(at / edge).T[::-1]))
    widths = at[order, 0]
    return [Interval(rows.iloc[part]) for part in np.split(order, np.flatnonzero(np.diff(widths)) + 1)]


def join_intervals(a: Interval, b: Interval, same: bool, least: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Compare two intervals: linked copies of each row of a, and of b, links that span what is linked, and pairs compared.

    Each side is cut in two until it has ``leaf`` rows; pairs of stretches whose boxes
    are farther apart than linked vectors can be are skipped.
    """
    far = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    of_a, of_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    stack, compared = [(0, len(a.ids), 0, len(b.ids))], 0
    while stack:
        i, j, k, m = stack.pop()
        if i >= j or k >= m or same and m <= i:
            continue
        if _apart(*a.box(i, j), *b.box(k, m)) > far:
            continue
        if j - i > leaf and j - i >= m - k:
            mid = a.middle(i, j)
            stack += [(i, mid, k, m), (mid, j, k, m)]
        elif m - k > leaf:
            mid = b.middle(k, m)
            stack += [(i, j, k, mid), (i, j, mid, m)]
        else:
            compared += (j - i) * (m - k)
            near = a.x[i:j] @ b.x[k:m].T >= least
            if same:
                # Each pair of rows once, below the diagonal of the whole interval.
                near &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
            if near.any():
                of_a[i:j] += near @ b.copies[k:m]
                of_b[k:m] += a.copies[i:j] @ near
                x, y = np.nonzero(near)
                ends.append(spanning_links(a.ids[i + x], b.ids[k + y]))
    links = spanning_links(*(np.concatenate(v) for v in zip(*ends, strict=True))) if ends else (np.zeros(0, np.int64),) * 2
    return of_a, of_b, *links, compared


def reached(at: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, far: float) -> list[np.ndarray]:
    """For each row the intervals that it visits: those whose box is within reach.

    Of two intervals the rows of one visit the other: of the later one if the
    sum of their numbers is even, of the earlier one otherwise. Rows come in
    grid order, so boxes out of reach of a whole stretch are tested once.
    """
    out: list[np.ndarray] = []
    for start in range(0, len(at), LEAF):
        some, mine = at[start : start + LEAF], own[start : start + LEAF, None]
        near = np.flatnonzero(_apart(some.min(axis=0), some.max(axis=0), lo, hi) <= far)
        met = ((near + mine) % 2 == 0) == (near < mine)
        met &= near != mine
        for c, box in enumerate(near):
            met[:, c] &= _apart(some, some, lo[box], hi[box]) <= far
        out += [near[row] for row in met]
    return out


_FOUND = "u long, v long, n long, link boolean"


def _links_of_cells(edge: float, least: float, leaf: int, count: Callable[[int], None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Join the rows of each cell: first its interval's own rows, then its visitors, which stream through."""

    def joined(a: Interval, b: Interval) -> pd.DataFrame:
        of_a, of_b, x, y, compared = join_intervals(a, b, a is b, least, leaf)
        count(compared)
        counts = pd.DataFrame({"u": a.ids, "n": of_a + of_b}) if a is b else pd.DataFrame({"u": np.concatenate([a.ids, b.ids]), "n": np.concatenate([of_a, of_b])})
        return pd.concat([counts[counts["n"] > 0].assign(v=-1, link=False), pd.DataFrame({"u": x, "v": y, "n": 0, "link": True})], ignore_index=True)[["u", "v", "n", "link"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, own, home = None, [], None
        for batch in batches:
            cells = batch["cell"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(cells)], strict=True):
                if cells[lo] != cell:
                    if own:
                        yield from at_home(cell, in_order(pd.concat(own), edge))
                    cell, own, home = cells[lo], [], None
                rows = batch.iloc[lo:hi]
                if len(mine := rows[~rows["visits"]]):
                    own.append(mine)
                if len(guests := rows[rows["visits"]]):
                    if home is None:
                        home = in_order(pd.concat(own), edge)
                        yield from at_home(cell, home)
                        own = []
                    for b in in_order(guests, edge):
                        for a in home:
                            if a.x.shape[1] == b.x.shape[1]:
                                yield joined(a, b)
        if own:
            yield from at_home(cell, in_order(pd.concat(own), edge))

    def at_home(cell: int, home: list[Interval]) -> Iterator[pd.DataFrame]:
        # Only the first part of an interval's cells compares its rows with each other.
        if cell % _PARTS == 0:
            for a in home:
                yield joined(a, a)

    return run


#: A cell is _PARTS * interval + part; an interval with too many visitors has several parts.
_PARTS = 1 << 32


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, interval: int = INTERVAL, leaf: int = LEAF, visitors: int = VISITORS, count: Callable[[int], None] = lambda n: None) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of one length link if their cosine in double precision is at least
    ``least``. Null, empty, zero and non-finite vectors link with nothing.
    n_links counts the other rows linked directly, equal ones included;
    component_id is the smallest vec_id reachable by links; kept says that it
    is the row's own. Of repeated ids every row counts as a vector, and all of
    them get the component of the id. Rows with a null id link with nothing.
    The empty table gives the empty table. Other columns don't matter.

    1. Equal unit vectors become one row with a count, so a hot vector costs
       nothing further.
    2. Rows are sorted by their grid cell (edge: the distance of linked
       vectors) on the leading principal axes, and the order is cut into
       intervals of ``interval`` rows with a box each.
    3. An interval's rows go to its own cell once, and visit the cells of those
       intervals whose boxes are within their own reach. There the intervals
       are cut on and on, down to ``leaf`` rows, and provably distant stretches
       are skipped (`join_intervals`). A cell with over ``visitors`` visitors is
       dealt to several tasks.
       A task returns counts of links and a spanning forest.

    ``count`` is told how many pairs each join compared (an accumulator's add).
    """
    spark = vectors.sparkSession
    units = materialise(unit_vectors(vectors, vec_id=vec_id, embedding=embedding))
    takes_part = F.coalesce(F.col("vec_id").isNotNull() & (F.size("x") > 0), F.lit(False))
    members = units.where(takes_part)
    one = materialise(members.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    # Of lengths that are equally frequent the largest.
    usual = one.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if usual is None:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n = one.count()
    edge = float(np.sqrt(max(1e-6, 2 - 2 * least)))
    axes = fit_axes(one, usual["n"], usual["width"])

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(positions(x.tolist(), axes)), dtype=object)

    placed = one.withColumn("at", project("x")).withColumn("cell", F.transform("at", lambda v: F.floor(v / edge)))
    ranges = min(MOST_INTERVALS, max(1, -(-n // (8 * interval))))
    ordered = placed.repartitionByRange(ranges, "cell", "vec_id").sortWithinPartitions("cell", "vec_id").drop("cell")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield batch.assign(part=part, nth=at + np.arange(len(batch)))
            at += len(batch)

    # Written with a row's number in its range, so intervals don't depend on how the order was cut into ranges.
    numbered = materialise(ordered.mapInPandas(number, "x array<double>, vec_id long, copies long, at array<double>, part int, nth long"))
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *(k for _, k in sizes)])
    firsts = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts[:-1], strict=True)], "part int, first long")
    length = max(interval, -(-n // MOST_INTERVALS))
    rows = numbered.join(F.broadcast(firsts), "part").withColumn("interval", F.floor((F.col("first") + F.col("nth")) / length).cast("int")).drop("part", "nth", "first")
    corner = lambda f: F.array(*[f(F.element_at("at", i + 1)) for i in range(1 + len(axes))])
    boxes = sorted(rows.groupBy("interval").agg(corner(F.min).alias("lo"), corner(F.max).alias("hi")).collect())
    shared = spark.sparkContext.broadcast((np.array([b["lo"] for b in boxes]), np.array([b["hi"] for b in boxes])))

    @F.pandas_udf("array<int>")
    def visited(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for at, own in batches:
            yield pd.Series(reached(np.stack(at.to_numpy()), own.to_numpy(), *shared.value, edge + 1e-9) if len(at) else [], dtype=object)

    visits = rows.select(F.explode(visited("at", "interval")).alias("interval")).groupBy("interval").agg(F.count("*").alias("n"))
    parts = np.ones(len(boxes), np.int64)
    for r in visits.where(F.col("n") > visitors).collect():
        parts[r["interval"]] = -(-r["n"] // visitors)
    cut = spark.sparkContext.broadcast(parts)

    @F.pandas_udf("array<long>")
    def dealt(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The cells that a row goes to: all parts of its own interval's, and, as -1 - cell, a part of each that it visits."""
        for at, own, ids in batches:
            some = reached(np.stack(at.to_numpy()), own.to_numpy(), *shared.value, edge + 1e-9) if len(at) else []
            yield pd.Series([np.r_[i * _PARTS + np.arange(cut.value[i]), -1 - (to * _PARTS + u % cut.value[to])] for i, to, u in zip(own, some, ids, strict=True)], dtype=object)

    sent = rows.select("vec_id", "copies", "x", "at", F.explode(dealt("at", "interval", "vec_id")).alias("to"))
    sent = sent.select("vec_id", "copies", "x", "at", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("cell"), (F.col("to") < 0).alias("visits"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = materialise(sent.repartition(tasks, "cell").sortWithinPartitions("cell", "visits").mapInPandas(_links_of_cells(edge, least, leaf, count), _FOUND))
    counts = found.where("NOT link").groupBy("u").agg(F.sum("n").alias("n"))
    equal = members.join(one.select("x", F.col("vec_id").alias("u"), "copies"), "x").select("vec_id", "u", "copies")
    # Rows that share an id, and rows that share a vector, are one component as well.
    same = equal.where("vec_id <> u").select(F.col("vec_id").alias("a"), F.col("u").alias("b"))
    links = found.where("link").select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(same)
    component = connected_components(links)
    linked = equal.join(counts, "u", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rest = linked.unionByName(units.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links")))
    out = rest.join(component, F.col("vec_id") == F.col("node"), "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
