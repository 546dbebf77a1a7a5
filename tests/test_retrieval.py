"""Index, store, ingestion, retrieval, sources, streaming: behaviour and the five guarantees."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse import queries as q
from gatehouse.errors import AclResolutionError, InvalidRequestError, SourceError, StoreError, VectorIndexError
from gatehouse.functions import text
from gatehouse.operators import index as ix
from gatehouse.operators import ingest as ing
from gatehouse.operators import store, topk
from gatehouse.operators.index import VectorIndex, admitted_bitmaps, batch_search, intern_policies
from gatehouse.operators.retrieve import Request, answer, fetch_hits
from gatehouse.operators.simulate import simulate
from gatehouse.plans.shape import executed_plan, filters_below
from gatehouse.plans.tables import Tables
from gatehouse.principals import Groups, Principal
from gatehouse.schemas import CHUNKS, DOCUMENTS, INDEX, RAW
from gatehouse.service.api import Api
from gatehouse.service.settings import Settings
from gatehouse.sources import drive, filesystem, formats
from gatehouse.sources.registry import Registry
from gatehouse.streaming.acl_cache import EpochCache, replay_log, replay_stream
from gatehouse.streaming.ingest import stream_ingest

TEXTS = {
    "index-design": (["eng", "everyone"], ["contractors"], "The retrieval index is designed as flat codes. It is scanned for each query."),
    "runbook": (["eng", "sre"], [], "On call: restart the retrieval service, then look at the index."),
    "forecast": (["finance"], [], "The forecast for the third quarter is confidential."),
    "onboarding": (["everyone"], [], "Welcome. Read the handbook and meet your team."),
    "secret": ([], [], "Nobody may read about the retrieval index here."),
}


def raw(spark, texts=TEXTS):
    rows = [(f"t:{n}", "t", f"file:///{n}", n, "1", g, d, t) for n, (g, d, t) in texts.items()]
    return spark.createDataFrame(rows, RAW)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    t = Tables(spark, f"file://{tmp_path_factory.mktemp('tables')}")
    report = ing.ingest(t, raw(spark), ing.local_embedder(64))
    assert (report.documents, report.skipped_unchanged, report.quarantined, report.version) == (5, 0, 0, 1)
    return t


def ask(spark, tables, who, query, k=10, rerank=None):
    """The answer to one request, of what the groups make of a principal, or of a permission set."""
    api = Api(spark, Settings(tables.root, None, 60.0, 64), rerank)
    held = GROUPS.resolve(who) if isinstance(who, Principal) else frozenset(who)
    return api.ask(Request(Principal.of("u"), query, k), held)


GROUPS = Groups({"sre": ["eng"], "eng": ["staff"]})


def test_end_to_end_scopes_and_counts(spark, tables):
    got = ask(spark, tables, Principal.of("carol", "sre", "contractors"), "how is the retrieval index designed", 5)
    found = {r["citation"]["document_id"] for r in got["results"]}
    assert found == {"t:runbook", "t:onboarding"} and (got["returned"], got["candidates"]) == (2, 2)
    everyone = ask(spark, tables, Principal.of("dan", "eng"), "retrieval index design", 5)["results"]
    assert {r["citation"]["document_id"] for r in everyone} == {"t:index-design", "t:runbook", "t:onboarding"}
    assert [r["score"] for r in everyone] == sorted((r["score"] for r in everyone), reverse=True)


def test_batches_of_requests(spark, tables):
    now = tables.read()
    index = VectorIndex(now["index"], now["policies"], now["quant"])
    words = "the retrieval index"
    asked = spark.createDataFrame([(n, words, p, text.embed_text(words, 64).tolist()) for n, p in (("a", ["eng"]), ("b", ["finance", "everyone"]), ("c", []), ("d", None))], "query_id string, query string, permissions array<string>, vector array<float>")
    rows = answer(index, now["chunks"], now["documents"], asked, 1, candidate_k=4).collect()
    assert {r["query_id"]: r["candidates"] for r in rows} == {"a": 2, "b": 3}
    assert all(r["rank"] == 1 for r in rows)


def test_nothing_runs_for_an_empty_permission_set(spark, tables, monkeypatch):
    def fail(_):
        raise AclResolutionError("down")

    api = Api(spark, Settings(tables.root, None, 60.0, 64))
    api.cache = EpochCache(fail)
    monkeypatch.setattr(api, "embed", lambda _: pytest.fail("the query was embedded"))
    monkeypatch.setattr(api.tables, "read", lambda: pytest.fail("a table was read"))
    assert api.retrieve({"X-Gatehouse-Principal": "x"}, "index")["returned"] == 0


def test_a_leaky_index_leaks_no_text(spark, tables):
    now = tables.read()
    hits = now["chunks"].select(F.lit("q").alias("query_id"), "chunk_id", F.lit(1.0).alias("score"))
    asked = spark.createDataFrame([("q", ["u", "everyone"])], "query_id string, permissions array<string>")
    got = fetch_hits(hits, asked, now["chunks"], now["documents"]).collect()
    assert {r["document_id"] for r in got} == {"t:index-design", "t:onboarding"}
    assert "text" not in INDEX.names


def test_the_policy_filter_is_below_the_scores(spark, tables):
    now = tables.read()
    found = VectorIndex(now["index"], now["policies"], now["quant"]).search([0.1] * 64, {"eng", "sre"}, 5)
    plan = executed_plan(found)
    assert filters_below(found, r"Filter.*policy_id", r"TakeOrderedAndProject")
    assert "In(policy_id" in plan.split("PushedFilters")[1]
    assert "text" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_returned_equals_admitted_for_random_policies(spark, tmp_path):
    rng = random.Random(6)
    ids = [f"g{i}" for i in range(5)]
    texts = {f"d{i}": (rng.sample(ids, rng.randint(0, 3)), rng.sample(ids, rng.randint(0, 2)), f"text number {i} about things") for i in range(40)}
    t = Tables(spark, f"file://{tmp_path}/t")
    ing.ingest(t, raw(spark, texts), ing.local_embedder(64))
    for held in (["g0"], ["g1", "g3"], ids, ["other"]):
        want = {f"t:{n}" for n, (g, d, _) in texts.items() if set(g) & set(held) and not set(d) & set(held)}
        got = ask(spark, t, held, "text", 200)
        assert {r["citation"]["document_id"] for r in got["results"]} == want
        assert got["returned"] == len(want)


def test_ingest_skips_replaces_quarantines_and_prunes(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    ing.ingest(t, raw(spark), ing.local_embedder(64))
    again = ing.ingest(t, raw(spark), ing.local_embedder(64))
    assert (again.documents, again.skipped_unchanged, again.version) == (0, 5, 1)
    changed = dict(TEXTS, runbook=(["eng"], [], TEXTS["runbook"][2]), onboarding=(["everyone"], [], "  \n"))
    bad = spark.createDataFrame([("", "t", "u", "x", None, ["a"], [], "text"), (" pad", "t", "u", "x", None, ["a"], [], "text")], RAW)
    report = ing.ingest(t, raw(spark, changed).union(bad), ing.local_embedder(64))
    assert (report.documents, report.skipped_unchanged, report.quarantined, report.version) == (2, 3, 2, 2)
    now = t.read()
    assert now["documents"].count() == 5 and now["chunks"].count() == now["index"].count() == 4
    assert now["chunks"].where("document_id = 't:runbook'").first()["grants"] == ["eng"]
    assert t.read(1)["chunks"].count() == 5
    few = {k: changed[k] for k in ("runbook", "secret")}
    ing.ingest(t, raw(spark, few), ing.local_embedder(64), prune=True)
    assert {r[0] for r in t.read()["index"].select("document_id").collect()} == {"t:runbook", "t:secret"}
    assert ing.refit(t, ing.local_embedder(64)) == 4


def test_versions_grow_by_what_changes(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    docs = raw(spark)
    # One policy first, which gets id 0, then others.
    ing.ingest(t, docs.where("title = 'forecast'"), ing.local_embedder(64))
    ing.ingest(t, docs, ing.local_embedder(64))
    now = t.read()
    index = VectorIndex(now["index"], now["policies"], now["quant"]).validate(now["chunks"].count())
    assert now["policies"].count() == now["policies"].select("policy_id").distinct().count() == 5
    assert {r["document_id"] for r in index.search([0.1] * 64, ["sre"], 5).collect()} == {"t:runbook"}
    assert {r["document_id"] for r in index.search([0.1] * 64, ["finance"], 5).collect()} == {"t:forecast"}
    ing.ingest(t, docs.where("title = 'secret'").withColumn("text", F.lit("other words")), ing.local_embedder(64))
    last = t.manifest(3)["parts"]
    assert len(last) == 3 and spark.read.parquet(f"{t.root}/chunks/p={last[2]}").count() == 1
    before = sorted(map(tuple, t.read()["chunks"].collect()))
    assert len(before) == 5 and t.bytes_of("index") > 0
    assert t.compact() == 4 and len(t.manifest(4)["parts"]) == 1
    assert sorted(map(tuple, t.read()["chunks"].collect())) == before
    assert sorted(map(tuple, t.read(2)["chunks"].collect())) != before
    with pytest.raises(StoreError, match="another writer"):
        t.publish({"policies": now["policies"]}, after=3)
    with pytest.raises(StoreError, match="ids of their own"):
        t.publish({"policies": now["policies"].union(now["policies"])}, after=4)
    assert t.current() == 4
    with pytest.raises(VectorIndexError):
        VectorIndex(now["index"], now["policies"].where("policy_id > 1"), now["quant"]).validate()
    with pytest.raises(VectorIndexError):
        VectorIndex(now["index"], now["policies"], now["quant"].withColumn("dimension", F.lit(65))).validate()


def test_batches_filter_policies_in_the_scan(spark, sf):
    found = q.batch_scoped_search(spark, sf)
    plan = executed_plan(found)
    assert "In(policy_id" in plan.split("PushedFilters")[1] or "EqualTo(policy_id" in plan
    assert filters_below(found, r"Filter.*policy_id", r"MapInArrow")
    assert "text" not in plan and "Join" not in plan and "CartesianProduct" not in plan
    # What is sorted has left the tasks as the best of a query.
    assert plan.index("Sort") < plan.index("MapInArrow")


@pytest.mark.parametrize("batch", [topk.BATCH_BYTES, 700])
def test_bounded_top_k_equals_brute_force(spark, batch, monkeypatch):
    rng = np.random.default_rng(3)
    n, dim = 700, 70
    v = np.round(rng.normal(size=(n, dim)), 1)
    v[50:90] = v[10:50]  # ties
    v[95] = 0
    rules = [(sorted(rng.choice(list("abcdef"), rng.integers(0, 3), replace=False).tolist()), sorted(rng.choice(list("abcdef"), rng.integers(0, 2), replace=False).tolist())) for _ in range(n)]
    entries = spark.createDataFrame([(f"c{i:04d}", "d", v[i].tolist(), *rules[i]) for i in range(n)], "chunk_id string, document_id string, vector array<double>, grants array<string>, denies array<string>").repartition(5)
    index = VectorIndex.build(entries)
    asked = [(f"q{i}", sorted(rng.choice(list("abcdefg"), rng.integers(0, 4), replace=False).tolist()), v[i].tolist()) for i in range(12)]
    monkeypatch.setattr(topk.k_best, "__kwdefaults__", {**topk.k_best.__kwdefaults__, "batch_bytes": batch})
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    queries = spark.createDataFrame(asked, "query_id string, permissions array<string>, vector array<double>")
    got = {}
    for r in batch_search(index, queries, 7, candidates=60).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], round(r["score"], 9)))
    for name, held, x in asked:
        # As many candidates as the batch keeps.
        want = index.search(x, held, 60, rescore=1).limit(7).collect() if held else []
        assert sorted(got.get(name, [])) == [(i + 1, r["chunk_id"], round(r["score"], 9)) for i, r in enumerate(want)], name
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(n)] + [(9999, None)], "id long, vector array<double>").repartition(4)
    some = spark.createDataFrame([(i, v[i].tolist()) for i in range(9)], "query_id long, vector array<double>")
    best = {}
    for r in topk.k_best(rows, some, 5, topk.largest_products, key="id", order="under double").collect():
        best.setdefault(r["query_id"], []).append((r["under"], r["id"]))
    for i in range(9):
        assert sorted(best[i]) == sorted((-float(np.cumsum(v[j] * v[i])[-1]), j) for j in range(n))[:5]


def test_bitmaps_of_policies_equal_the_predicate(spark, monkeypatch):
    rng = random.Random(8)
    ids = [f"p{i}" for i in range(9)]
    rules = {(tuple(sorted(rng.sample(ids, rng.randint(0, 4)))), tuple(sorted(rng.sample(ids, rng.randint(0, 3))))) for _ in range(300)}
    made = intern_policies(spark.createDataFrame([(list(g), list(d)) for g, d in rules], "grants array<string>, denies array<string>").repartition(7))
    known = {r["policy_id"]: r for r in made.collect()}
    # Dense, in the order of the key, and more than a bitmap of Spark holds when moved up.
    assert sorted(known) == list(range(len(rules))) and [known[i]["policy_key"] for i in range(len(rules))] == sorted(r["policy_key"] for r in known.values())
    sets = [sorted(rng.sample(ids, n)) for n in range(10)]
    for shift in (0, 70_000):
        held = spark.createDataFrame([(s,) for s in sets], "held array<string>").distinct()
        found = admitted_bitmaps(held, made.withColumn("policy_id", F.col("policy_id") + shift))
        plan = executed_plan(found)
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "array_contains" not in plan
        bits = {tuple(r["held"]): np.flatnonzero(np.unpackbits(np.frombuffer(r["admitted"], np.uint8), bitorder="little")).tolist() for r in found.collect()}
        for s in sets:
            want = [i + shift for i, r in known.items() if set(r["grants"]) & set(s) and not set(r["denies"]) & set(s)]
            assert bits.get(tuple(s), []) == sorted(want)


def test_a_dead_writer_leaves_the_store_whole(spark, tmp_path, monkeypatch):
    t = Tables(spark, f"file://{tmp_path}/t")
    ing.ingest(t, raw(spark), ing.local_embedder(64))
    before = sorted(map(tuple, t.read()["chunks"].collect()))
    changed = raw(spark).where("title = 'secret'").withColumn("text", F.lit("other words"))

    class Died(BaseException):
        pass

    def die(*_):
        raise Died

    steps = [(Tables, "_appear", die), (Tables, "stage", die)]
    # In between: the text of the version is written aside and not yet renamed.
    whole = Tables._appear

    def written_aside(self, version, text):
        files, aside = self._file(f"versions/.{version}-dead")
        files.create(aside, False).close()
        die()

    for owner, name, how in [*steps, (Tables, "_appear", written_aside)]:
        with monkeypatch.context() as m, pytest.raises(Died):
            m.setattr(owner, name, how)
            ing.ingest(t, changed, ing.local_embedder(64))
        assert t.current() == 1 and sorted(map(tuple, t.read()["chunks"].collect())) == before
    # What an older writer may have left: an empty file of the next number.
    files, path = t._file("versions/2")
    files.create(path, False).close()
    assert t.current() == 1 and sorted(map(tuple, t.read()["chunks"].collect())) == before
    assert Tables._appear is whole and ing.ingest(t, changed, ing.local_embedder(64)).version == 2
    assert {r["text"] for r in t.read()["chunks"].where("document_id = 't:secret'").collect()} == {"other words"}
    with pytest.raises(StoreError, match="another writer"):
        t.publish({"policies": t.read()["policies"]}, after=1)


def test_failed_embedding_publishes_nothing(spark, tmp_path):
    def broken():
        def call(texts):
            raise RuntimeError("secret text: " + texts[0])

        return call

    t = Tables(spark, f"file://{tmp_path}/t")
    with pytest.raises(Exception, match="embedding failed") as e:
        ing.ingest(t, raw(spark), ing.remote_embedder(broken, 8))
    assert "secret text" not in str(e.value)
    assert t.current() is None
    fine = lambda: lambda texts: [[float(len(x)), 1.0] for x in texts]
    assert ing.ingest(t, raw(spark), ing.remote_embedder(fine, 2, batch=2)).documents == 5


def test_requests_and_reranking(spark, tables):
    for bad in ({"k": 0}, {"k": 1001}, {"query": " "}, {"query": "x" * 20_001}, {"candidate_multiplier": 0}):
        with pytest.raises(InvalidRequestError):
            Request(**{"principal": Principal.of("u"), "query": "q", **bad})
    assert Request(Principal.of("u"), "q", 1000, 10).candidate_k == 4000

    def rerank(query, texts, n):
        assert not any("Nobody" in t or "confidential" in t for t in texts)
        return [(i, float(i) + 10 * len(texts)) for i in range(len(texts))][-n:]

    got = ask(spark, tables, Principal.of("u", "eng"), "retrieval index", 2, rerank)
    assert [r["score"] for r in got["results"]] == [32.0, 31.0] and got["candidates"] == 3
    with pytest.raises(Exception, match="out of range"):
        ask(spark, tables, Principal.of("u", "eng"), "retrieval index", 2, lambda q, t, n: [(9, 1.0)])


def test_drifted_ranges_are_fitted_anew(spark, tmp_path):
    rng = np.random.default_rng(5)
    made: dict[str, list[float]] = {}

    def embed(chunks):
        kept = spark.createDataFrame(list(made.items()), "text string, vector array<double>")
        return chunks.join(kept, "text").select("chunk_id", F.col("vector").cast("array<float>").alias("vector"))

    def docs(kind, n, shift):
        texts = {f"{kind}{i}": (["eng"], [], f"{kind} text {i}") for i in range(n)}
        for i in range(n):
            made[f"{kind} text {i}"] = (rng.normal(size=32) * 0.1 + shift).tolist()
        return raw(spark, texts)

    t = Tables(spark, f"file://{tmp_path}/t")
    near, far = np.r_[1.0, np.zeros(31)], np.r_[np.zeros(31), -1.0]
    assert not ing.ingest(t, docs("a", 150, near), embed).refitted
    assert ix.clipped_share(t.ranges()) == 0 and t.ranges().select("dimension").distinct().count() == 32
    shifted = docs("b", 150, far)
    kept = ing.ingest(t, shifted.limit(0), embed)
    assert not kept.refitted
    report = ing.ingest(t, shifted, embed)
    assert report.refitted and report.version == t.current() == 3
    assert ix.clipped_share(t.ranges()) == 0
    now = t.read()
    index = VectorIndex(now["index"], now["policies"], now["quant"]).validate(300)
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in made.items()}
    text_of = {r["chunk_id"]: r["text"] for r in now["chunks"].select("chunk_id", "text").collect()}
    names = [k for i, k in enumerate(made) if i % 15 == 0]
    asked = spark.createDataFrame([(k, ["eng"], made[k]) for k in names], "query_id string, permissions array<string>, vector array<double>")
    hits = 0
    for r in batch_search(index, asked, 10, candidates=300).collect():
        best = sorted(made, key=lambda k: -float(unit[k] @ unit[r["query_id"]]))[:10]
        hits += text_of[r["chunk_id"]] in best
    assert hits / (10 * len(names)) >= 0.95


def test_store_reads(spark, tables):
    now = tables.read()
    assert now["documents"].schema.names == DOCUMENTS.names and now["chunks"].schema.names == CHUNKS.names
    listed = store.list_documents(now["documents"], {"everyone", "contractors"}, 10)
    assert [r["document_id"] for r in listed.collect()] == ["t:onboarding"] and "text" not in listed.columns
    assert store.list_documents(now["documents"], {"everyone"}, 0).count() == 0
    assert store.list_documents(now["documents"], set(), 5).count() == 0
    rows = {r["document_id"]: (r["visible"], r["reason"]) for r in simulate(now["documents"], ["contractors", "eng", "everyone"]).collect()}
    assert rows["t:index-design"] == (False, "denied via contractors") and rows["t:secret"] == (False, "no grants")
    assert rows["t:runbook"] == (True, "granted via eng")


def test_folder_source(spark, tmp_path):
    root = tmp_path / "docs"
    for name, content in {"a.md": "top", "eng/b c.txt": "b", "eng/deep/c.rst": "c", "eng/deep/d.md": "d", "bad/e.md": "e", "eng/skip.pdf": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (root / "eng/raw.md").write_bytes(b"caf\xe9")
    rules = filesystem.DIRECTORY_SIDECAR
    (root / rules).write_text(json.dumps({"grants": ["everyone"]}))
    (root / "eng" / rules).write_text(json.dumps({"grants": ["eng", "eng"], "denies": ["x"]}))
    (root / "eng/deep/d.md.acl.json").write_text(json.dumps({"grants": ["sre"]}))
    (root / "bad" / rules).write_text(json.dumps({"grants": ["a"], "denies": "x"}))
    rows, skipped = filesystem.read_folder(spark, str(root))
    got = {r["title"]: (r["grants"], r["denies"], r["text"]) for r in rows.collect()}
    assert got == {"a.md": (["everyone"], [], "top"), "b c.txt": (["eng"], ["x"], "b"), "c.rst": (["eng"], ["x"], "c"), "d.md": (["sre"], [], "d"), "e.md": ([], [], "e"), "raw.md": (["eng"], ["x"], "caf�")}
    assert skipped.count() == 0
    with pytest.raises(SourceError):
        filesystem.path_of(f"file://{root}/../other.md", str(root))
    for wrong in ("[]", "{", '{"grants": [1]}', '{"grants": ["a b"]}'):
        with pytest.raises(SourceError):
            filesystem.parse_rules(wrong)
    registry = Registry(spark, f"file://{tmp_path}/registry")
    registry.put("docs", formats.FOLDER, root=str(root))
    for name, kind, options in (("a b", formats.FOLDER, {"root": "x"}), ("x", "other", {}), ("x", formats.DRIVE, {})):
        with pytest.raises(SourceError):
            registry.put(name, kind, **options)
    (root / "link.md").symlink_to(tmp_path / "outside.md")
    (tmp_path / "outside.md").write_text("outside")
    t = Tables(spark, f"file://{tmp_path}/t")
    report = registry.run("docs", t, ing.local_embedder(64))
    assert (report.documents, report.quarantined) == (6, 1)
    assert [r["reason"] for r in t.set_aside().collect()] == ["unreadable: SourceError"]
    registry.put("gone", formats.FOLDER, root=str(tmp_path / "nowhere"))
    assert registry.run("gone", t, ing.local_embedder(64)) is None
    registry.forget("gone")
    again = Registry(spark, registry.path)
    assert [(r["name"], r["options"]["root"]) for r in again.sources().collect()] == [("docs", str(root))]
    assert sorted((r["name"], r["documents"], r["error"] is None) for r in again.runs().collect()) == [("docs", 6, True), ("gone", 0, False)]
    with pytest.raises(SourceError):
        again.run("gone", t, ing.local_embedder(64))


def test_folder_of_many_files(spark, tmp_path):
    root = tmp_path / "many"
    for i in range(10_000):
        path = root / f"a{i % 7}" / f"b{i % 60}" / f"{i}.md"
        if i < 420:
            path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text {i}")
    for i in range(7):
        (root / f"a{i}" / filesystem.DIRECTORY_SIDECAR).write_text(json.dumps({"grants": [f"g{i}"]}))
    formats.register(spark)
    read = spark.read.format(formats.FOLDER).option("root", str(root)).option("shares", 20).load()
    assert read.rdd.getNumPartitions() == 20
    got = read.select("title", "grants", "text", "error").collect()
    assert sorted((r["title"], r["grants"], r["text"], r["error"]) for r in got) == sorted((f"{i}.md", [f"g{i % 7}"], f"text {i}", None) for i in range(10_000))
    some = read.where(F.col("uri").startswith(f"file://{root}/a3/b"))
    assert some.count() == sum(i % 7 == 3 for i in range(10_000))
    plan = executed_plan(some)
    assert "StartsWith" not in plan.split("BatchScan")[0]
    assert read.where(F.col("uri") == f"file://{root}/a3/b3/3.md").select("text").first()["text"] == "text 3"
    assert read.where(f"uri IN ('file://{root}/a3/b3/3.md', 'file://{root}/x.md') AND title = '3.md'").count() == 1


def test_a_folder_as_a_stream(spark, tmp_path):
    root, progress = tmp_path / "docs", tmp_path / "progress.json"
    root.mkdir()
    rules = root / filesystem.DIRECTORY_SIDECAR
    rules.write_text(json.dumps({"grants": ["eng"]}))
    os.utime(rules, ns=(1, 1))

    def put(name, text, at):
        (root / name).write_text(text)
        os.utime(root / name, ns=(at, at))

    for i in range(10):
        put(f"{i}.md", f"first {i}", 100 + i // 2)
    formats.register(spark)
    seen, sizes, dying = [], [], []

    def take(batch, number):
        rows = [(r["title"], r["text"]) for r in batch.collect()]
        if dying and dying[0] == number:
            dying.clear()
            raise RuntimeError("the sink died")
        seen.extend(rows)
        sizes.append(len(rows))

    def run():
        stream = spark.readStream.format(formats.FOLDER).options(root=str(root), progress=str(progress), max_files="4", settle="0").load()
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    dying.append(1)
    with pytest.raises(Exception, match="the sink died"):
        run()
    assert len(seen) == 4
    run()
    assert sorted(seen) == sorted((f"{i}.md", f"first {i}") for i in range(10)) and max(sizes) == 4
    put("3.md", "second 3", 900)
    put("new.md", "new", 901)
    run()
    assert sorted(seen[10:]) == [("3.md", "second 3"), ("new.md", "new")]
    # Other rules change what they decide for.
    os.utime(rules, ns=(950, 950))
    run()
    assert len(seen) == 12 + 11 and max(sizes) == 4


def test_drive_source(spark):
    files = [{"id": "1", "name": "One", "mimeType": drive.DOCUMENT_TYPE, "modifiedTime": "t"}, {"id": "2", "mimeType": "text/plain"}, {"id": "3", "name": "gone", "mimeType": "text/markdown"}]

    def call(path, parameters):
        if path.endswith("/files"):
            asked = [f for f in files if f["mimeType"] in parameters["q"]]
            return {"files": asked, "nextPageToken": "n"} if "pageToken" not in parameters else {"files": []}
        if path.endswith("/1/permissions"):
            if "pageToken" in parameters:
                return {"permissions": [{"type": "domain", "domain": "d.org"}]}
            return {"permissions": [{"type": "user", "emailAddress": "u@x"}, {"type": "odd"}], "nextPageToken": "2"}
        if path.endswith("permissions"):
            return {"permissions": [{"type": "anyone"}]} if "/2/" in path else {"wrong": 1}
        if "/3" in path:
            raise SourceError("404")
        return f"text of {path}"

    rows, skipped = drive.read_drive(spark, call)
    got = {r["uri"]: (r["title"], r["grants"], r["text"]) for r in rows.collect()}
    assert got == {"gdrive://document/1": ("One", ["domain:d.org", "u@x"], "text of /drive/v3/files/1/export"), "gdrive://file/2": ("2", ["everyone"], "text of /drive/v3/files/2")}
    assert [r["uri"] for r in skipped.collect()] == ["gdrive://file/3"]
    uris = ["gdrive://abc", "gdrive://document/d/1", "http://x", "gdrive://thing/1", "gdrive://file/", None]
    parts = spark.createDataFrame([(u,) for u in uris], "u string").select(drive.uri_parts(F.col("u")).alias("p")).collect()
    assert [r["p"] and tuple(r["p"]) for r in parts] == [("file", "abc"), ("document", "d/1"), None, None, None, None]
    with pytest.raises(Exception, match="malformed"):
        drive.read_drive(spark, lambda path, parameters: {"wrong": 1})
    rows, skipped = drive.read_drive(spark, lambda path, parameters: {"files": []})
    assert rows.count() == skipped.count() == 0


def test_api(spark, tables, tmp_path):
    groups = tmp_path / "groups.json"
    groups.write_text(json.dumps({"sre": ["eng"]}))
    api = Api(spark, Settings(tables.root, str(groups), 60.0, 64))
    me = {"X-Gatehouse-Principal": "carol", "X-Gatehouse-Groups": "sre"}
    assert api.whoami(me)["effective"] == ["carol", "eng", "everyone", "sre"]
    assert api.health() == {"status": "ok", "documents": 5, "chunks": 5}
    assert api.index()["chunks"] == 5 and api.index()["bytes_on_disk"] > 0
    assert api.retrieve(me, "retrieval index", 2)["returned"] == 2
    seen = api.simulate("zed", ["finance"], "forecast", 3)
    assert seen["visible_count"] == 3 and seen["results"]["results"][0]["citation"]["title"] == "forecast"
    api.invalidate(group="eng")
    with pytest.raises(InvalidRequestError):
        api.invalidate()
    with pytest.raises(InvalidRequestError):
        Settings.from_env({"GATEHOUSE_DIMENSION": "9"})


def test_streams(spark, tmp_path, sf):
    source = str(tmp_path / "in")
    raw(spark).coalesce(1).write.parquet(source)
    t = Tables(spark, f"file://{tmp_path}/t")
    for _ in range(2):
        stream_ingest(spark.readStream.schema(RAW).parquet(source), t, ing.local_embedder(64), str(tmp_path / "cp")).awaitTermination()
    assert t.current() == 1 and t.read()["chunks"].count() == 5
    events = q.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    query = replay_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), 3600).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("replayed").collect())) == sorted(map(tuple, replay_log(events, 3600).collect()))


def test_policies_keep_their_ids(spark):
    a = spark.createDataFrame([(["x"], []), (["y"], ["x"])], "grants array<string>, denies array<string>")
    known = q.ix.intern_policies(a)
    more = q.ix.intern_policies(a.union(spark.createDataFrame([(["z"], [])], a.schema)), known)
    ids = {r["policy_key"]: r["policy_id"] for r in known.collect()}
    assert len({r["policy_id"] for r in more.collect()}) == 3
    assert all({r["policy_key"]: r["policy_id"] for r in more.collect()}[k] == i for k, i in ids.items())
