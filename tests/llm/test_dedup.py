"""SimHash and embedding near-duplicates, components: against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gatehouse.llm import embed_dedup, simhash
from gatehouse.llm import queries as q
from gatehouse.llm._components import connected_components, spanning_links


def least_reachable(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(spark, rows, got):
    fps = np.array([fingerprint(t, 3) for _, t in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = least_reachable(len(rows), zip(*np.nonzero(near), strict=True))
    groups = {}
    for (d, _), g in zip(rows, label, strict=True):
        groups.setdefault(g, []).append(d)
    want = sorted(((d, int(f), min((x for x in groups[g] if x is not None), default=None)) for (d, _), f, g in zip(rows, fps, label, strict=True)), key=str)
    have = sorted(((r["doc_id"], r["fp"][0] % (1 << 64), r["component_id"]) for r in got.collect()), key=str)
    assert have == want


def test_op3_equals_brute_force(spark, sf):
    docs = q.table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_simhash(spark, rows, simhash.simhash_groups(docs))
    out = q.op3_simhash(spark, sf)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert all(len(r[0]) == 16 and r[0] == r[0].lower() for r in out.select("fingerprint").collect())


def test_simhash_edge_rows(spark):
    rng = np.random.default_rng(3)
    base = " ".join(f"w{i}" for i in rng.integers(0, 500, 400))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, None), (4, "One"), (5, "one"), (5, "one"), (6, "a b"), (7, base), (8, base.upper()), (9, base + " x"), (10, base * 40), (11, "\x1cé a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "id": F.lit(0)})
    check_simhash(spark, rows, simhash.simhash_groups(docs))
    assert simhash.simhash_groups(docs.where("false")).collect() == []


@pytest.mark.parametrize(("bits", "blocks", "most"), [(32, 2, 3), (16, 4, 7)])
def test_links_are_complete_around_large_anchors(spark, bits, blocks, most):
    """Random fingerprints, and dense clouds whose anchors have more than SMALL_ANCHOR around them."""
    rng = np.random.default_rng(bits)
    spots = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    cloud = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for s in spots for _ in range(700)]
    fps = np.unique(np.array([*cloud, *rng.integers(0, 1 << 63, 300, dtype=np.uint64)], np.uint64))
    ids = fps.view(np.int64)
    table = spark.createDataFrame([(int(i), [int(i)]) for i in ids], "id long, fp array<long>")
    links = simhash.similar_links(table, lanes=1, block_bits=bits, blocks=blocks, most=most).collect()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most
    at = {int(i): k for k, i in enumerate(ids)}
    want = least_reachable(len(fps), zip(*np.nonzero(near), strict=True))
    assert least_reachable(len(fps), [(at[r["a"]], at[r["b"]]) for r in links]) == want
    assert len(links) < 300 * len(fps)


def test_wide_fingerprints_find_near_copies(spark):
    rng = np.random.default_rng(5)
    rows, kept = [], 60
    for d in range(kept):
        words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        rows.append((d, " ".join(words)))
        for at in rng.choice(300, 6, replace=False):
            words[at] = "changed"
        rows.append((1000 + d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs, shingle=5, lanes=4, block_bits=16, blocks=8, most=48).collect()}
    assert all(got[d] == d for d in range(kept))
    assert sum(got[1000 + d] == d for d in range(kept)) >= 0.95 * kept


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(200, 260)] + [tuple(map(int, x)) for x in rng.integers(0, 150, (60, 2))] + [(300, 300)]
    want = {n: c for n, c in enumerate(least_reachable(301, links))}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[n] == c for n, c in got.items())
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    a, b = spanning_links(np.array([5, 6, 9, 1]), np.array([6, 7, 10, 10]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 9), (1, 10), (5, 6), (5, 7)]


def check_vectors(rows, got, least=0.9):
    x = [np.array(v, float) if v is not None and None not in v else None for _, v in rows]
    with np.errstate(all="ignore"):
        x = [v / np.abs(v).max() if v is not None and len(v) and np.isfinite(v).all() and v.any() else v for v in x]
    ok = [v is not None and i is not None and len(v) > 0 and np.isfinite(v).all() and v.any() for v, (i, _) in zip(x, rows, strict=True)]
    links, counts = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and ok[a] and ok[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= least:
                links.append((a, b))
                counts[a] += 1
    label = least_reachable(len(rows), links)
    groups = {}
    for i, g in enumerate(label):
        groups.setdefault(g, []).append(rows[i][0])
    want = sorted((rows[i][0], counts[i], min(groups[label[i]]), rows[i][0] == min(groups[label[i]])) for i in range(len(rows)) if rows[i][0] is not None)
    have = sorted(tuple(r) for r in got.collect() if r["vec_id"] is not None)
    assert have == want


def test_op9_equals_brute_force(spark, sf):
    v = q.table(spark, sf, "embeddings").collect()
    x = np.array([r["embedding"] for r in v], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    label = least_reachable(len(v), zip(*np.nonzero(near), strict=True))
    ids = [r["vec_id"] for r in v]
    least = {g: min(ids[i] for i in range(len(v)) if label[i] == g) for g in set(label)}
    want = sorted((ids[i], int(near[i].sum()) - 1, least[label[i]], least[label[i]] == ids[i]) for i in range(len(v)))
    assert sorted(tuple(r) for r in q.op9_embed_dedup(spark, sf).collect()) == want


def test_embeddings_edge_rows_and_splitting(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(180)]
    rows += [(200 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(30)] + [(300, [2.0, 2.0, 2.0, 2.0])]
    rows += [(310, None), (311, [0.0] * 4), (312, [1.0, None, 0.0, 0.0]), (313, [float("nan"), 1.0, 0.0, 0.0]), (314, [float("inf"), 1.0, 0.0, 0.0]), (315, [1.0, 2.0]), (316, []), (319, [2.0, 4.0]), (320, [1.0, 2.1]), (321, [3.0]), (322, [1.0] * 5), (None, [1.0, 1.0, 1.0, 1.0]), (317, [1e-200, 0.0, 0.0, 0.0]), (318, [1e200, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "a": F.lit(2), "n_links": F.lit("z")})
    got = embed_dedup.near_duplicates(frame, interval=40, leaf=8, visitors=25)
    assert got.count() == len(rows)
    check_vectors(rows, got)
    assert embed_dedup.near_duplicates(frame.where("false")).collect() == []


def test_distant_stretches_are_skipped(spark):
    """Vectors in tight clusters: between intervals and within them, most pairs are never compared, and no link is lost."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 24)), 50, axis=0) + rng.normal(scale=0.05, size=(2000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    compared = spark.sparkContext.accumulator(0)
    got = embed_dedup.near_duplicates(frame, interval=400, leaf=20, count=compared.add).collect()
    assert {(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] < 50} == {(49, 0, False), (49, 0, True)}
    assert all(r["component_id"] == r["vec_id"] // 50 * 50 for r in got)
    assert 2000 * 49 / 2 <= compared.value < 0.1 * 2000 * 1999 / 2


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])]
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]


@pytest.mark.parametrize("sample", [20, 0])
def test_many_copies_of_few_vectors(spark, monkeypatch, sample):
    """The axes are fitted on distinct vectors, so few of them among many rows aren't missed; no sample at all costs no links."""
    monkeypatch.setattr(embed_dedup, "SAMPLE", sample)
    n = 3_000
    some = F.array(*[F.array(*[F.lit(float(v)) for v in x]) for x in ((3, 1, 0), (3, 1.1, 0), (0, 0, 2))])
    # Two of three rows are null or zero, and few are of another length.
    x = F.when(F.col("id") % 3 == 0, F.element_at(some, (F.col("id") / 3 % 3 + 1).cast("int"))).when(F.col("id") % 3 == 1, F.array(*[F.lit(0.0)] * 3))
    frame = spark.range(n).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 999 == 1, F.array(F.lit(1.0))).otherwise(x).alias("embedding"))
    got = {tuple(r) for r in embed_dedup.near_duplicates(frame).where("vec_id % 3 = 0").groupBy("n_links", "component_id").count().collect()}
    group = {c: sum(1 for i in range(0, n, 3) if i // 3 % 3 == c) for c in range(3)}
    assert got == {(group[0] + group[1] - 1, 0, group[0] + group[1]), (group[2] - 1, 6, group[2])}


@pytest.mark.parametrize(("block", "mass"), [(256, 1 << 18), (16, 1 << 18), (256, 3000), (8, 1500)])
def test_proven_links_join_what_brute_force_joins(spark, block, mass):
    """Groups that candidates chain: a hot one of near copies, texts that grow step by step, unrelated texts, short and long ones."""
    rng = np.random.default_rng(block)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]

    def changed(words, share):
        return [w if rng.random() > share else f"x{rng.integers(0, 5000)}" for w in words]

    seed, other, longer = word(120), word(90), word(1500)
    hot = [changed(seed, rng.choice([0.002, 0.01, 0.03])) for _ in range(220)] + [changed(other, 0.03) for _ in range(25)]
    steps = [longer[: int(20 * 1.12**i)] for i in range(38)]
    texts = {1: hot + steps + [word(n) for n in rng.integers(5, 300, 20)], 2: [changed(other, 0.02) for _ in range(9)], 3: [["a"], ["a", "b"], *[word(4) for _ in range(30)]], 4: [word(50)]}
    rows, seen = [], set()
    for group, members in texts.items():
        for words in members:
            text = " ".join(words)
            if text not in seen:
                seen.add(text)
                fp = np.packbits(simhash.fingerprint_bits(text, 5, 4, once=True)).view(">i8").tolist()
                rows.append((len(rows), group, fp, np.unique(simhash.shingle_hashes(text, 5)).view(np.int64).tolist()))
    sets = [set(r[3]) for r in rows]
    alike = [
        (i, j) for i in range(len(rows)) for j in range(i) if rows[i][1] == rows[j][1] and len(sets[i] & sets[j]) + 1e-9 >= 0.8 * (len(sets[i]) * len(sets[j])) ** 0.5
    ]
    want = least_reachable(len(rows), alike)
    assert len(set(want)) > 40 and max(want.count(x) for x in set(want)) > 100
    table = spark.createDataFrame(rows, "id long, group long, fp array<long>, shingles array<long>")
    found = [(r["a"], r["b"]) for r in simhash.proven_links(table, 0.8, 79, block, mass).collect()]
    assert least_reachable(len(rows), found) == want
    assert simhash.proven_links(table.where("false"), 0.8, 79, block, mass).collect() == []
