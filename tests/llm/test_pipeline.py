"""The corpus pipeline: each stage's contract, planted documents, and run() against its stages."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

import corpus_pipeline as cp
from gatehouse.llm import langid
from gatehouse.llm import queries as q
from gatehouse.llm._spark import materialise, small_table


def planted(spark, sf):
    """The table's documents and some with known fates."""
    docs = q.table(spark, sf, "documents")
    rng = random.Random(11)
    clean = docs.where("lang = 'en' AND n_chars BETWEEN 1500 AND 4000").orderBy("doc_id").limit(3).collect()
    rows = []
    for i, r in enumerate(clean):
        fresh = "the of and to in that it is with as on be at by this " + " ".join("".join(rng.sample("thandrionesght", 6)) for _ in range(250))
        words = fresh.split()
        near = list(words)
        for at in rng.sample(range(len(words)), 4):
            near[at] = "changed"
        rows += [(90_000 + 10 * i, fresh, "en", r["source"], len(fresh)), (90_001 + 10 * i, fresh, "en", r["source"], len(fresh)), (90_002 + 10 * i, " ".join(near), "en", r["source"], 1)]
    rows += [(99_000, None, None, None, 0), (99_001, "", "en", "src0", 0), (99_002, "12 34 !?", "en", None, 8)]
    return docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = materialise(planted(spark, sf))
    kept = {r["doc_id"] for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in q.table(spark, sf, "labels").collect()}
    for name, stage in cp.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf))
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        gone = kept - ids
        if name == "language_id":
            assert {99_000, 99_001, 99_002} <= gone and len(gone) < 0.02 * len(kept)
        if name == "toxicity":
            assert len([d for d in gone if labels.get(d) == 0]) <= 0.05 * len(labels)
            assert not any(d >= 90_000 for d in gone)
        if name == "simhash_near_dedup":
            assert {90_000, 90_010, 90_020} <= ids
            assert not any(d >= 90_000 and d % 10 for d in ids)
            assert out.count() == len(ids)
        docs, kept = out, ids
    packed = cp.pack(spark, docs, sf).collect()
    assert sum(r["piece"] == 0 for r in packed) == docs.count()


def test_run_is_its_stages(spark, sf):
    docs = q.table(spark, sf, "documents")
    for _, stage in cp.STAGES:
        docs = materialise(stage(spark, docs, sf))
    assert sorted(r["ids_crc32"] for r in cp.run(spark, sf).collect()) == sorted(r["ids_crc32"] for r in docs.collect())
    assert 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    rng = random.Random(3)
    a, b, c, d, e = ([f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(5))
    near = lambda words, k: " ".join([*words[:100], f"changed{k}", *words[101:]])
    a, b, c, d = map(" ".join, (a, b, c, d))
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "s"), (None, b, None), (None, near(b.split(), 1), "s")]
    rows += [(1, c, "s"), (1, d, "s"), (1, d, "s"), (2, near(c.split(), 2), "s"), (None, near(c.split(), 3), "s")]
    # The row of id 0 is another group's than that of id 3, though ids repeat.
    rows += [(3, " ".join(e), "s"), (0, near(e, 4), "s"), (3, "one text of its own " * 40, "s")]
    out = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    left = sorted(((r["doc_id"], r["text"]) for r in out), key=str)
    assert [x for x in left if x[0] is not None] == sorted([(0, near(e, 4)), (1, c), (1, d), (3, rows[-1][1])], key=str)
    nulls = [t for i, t in left if i is None]
    assert len(nulls) == 2 and a in nulls and (b in nulls or near(b.split(), 1) in nulls)


def test_stages_take_any_rows(spark, sf):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns of any name, and empty tables, through every stage."""
    words = " ".join(f"the w{i % 97} of x{i % 89} and" for i in range(400))
    rows = [(None, None, None, None), (None, words, None, "s"), (1, words + " and more", "en", None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "the of and " * 20_000, "en", "s"), (3, "12 !", "en", "t"), (None, "that this with for", None, None)]
    mine = {c: F.lit(f"my {c}") for c in ("_words", "_copy", "_h", "_g", "row", "found", "key", "h", "g", "maybe", "score", "size", "copies")}
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(mine))
    for name, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), sf).collect() == []
        got = stage(spark, docs, sf)
        last, got = got.columns != docs.columns, got.collect()
        assert got and last == (name == "best_fit_packing")
        assert last or all(r[c] == f"my {c}" for r in got for c in mine)
        if name == "simhash_near_dedup":
            # The texts without words are one group, words and its longer version another.
            assert sorted((r["text"] or "")[:9] for r in got) == ["", "12 !", "that this", "the of an", "the w0 of"]
        if name == "language_id":
            assert {r["text"] for r in got} == {t for _, t, _, _ in rows if t and t != "12 !"}
        if name == "best_fit_packing":
            assert sum(r["piece"] == 0 for r in got) == len(rows)


def test_first_stages_hold_little_of_a_large_input(spark, monkeypatch):
    """A worker that judges texts holds a few MB of them at once, however many there are."""

    class Parser:
        """Knows only languages of few texts at once."""

        samples = {"en": ""}

        def __init__(self, samples=None):
            pass

        def predict(self, texts):
            return ["en" if sum(map(len, texts)) < 6 << 20 else langid.UNKNOWN] * len(texts), [1.0] * len(texts)

    class Model:
        """Calls many texts at once toxic."""

        def score(self, text):
            import sys

            return float(sum(map(len, sys._getframe(1).f_locals["texts"])) > 6 << 20)

    # The classes above travel with the functions, as no worker can import them.
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: SimpleNamespace(value=value))
    monkeypatch.setattr(langid, "CrossParser", Parser)
    monkeypatch.setattr(q, "language_model", lambda *_: Parser())
    monkeypatch.setattr(q, "toxicity_model", lambda *_: Model())
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text"))
    for stage in (cp.keep_languages, cp.drop_toxic):
        out = stage(spark, docs, "")
        # The check and run() write what a stage returns, when the small batches are over.
        assert out.count() == materialise(out).count() == 3000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_small_tables_need_no_python_worker(spark):
    import datetime

    at = datetime.datetime(2020, 1, 2, 3, 4, 5)
    for rows, schema in (([(1, ["a", None], 0.5), (2, [], None)], "k int, p array<string>, x double"), ([(None, 1)], "n void, k long"), ([(at, True)], "t timestamp, b boolean"), ([], "k int, s string")):
        table = small_table(spark, rows, schema)
        assert [tuple(r) for r in table.collect()] == rows and table.schema == spark.createDataFrame([], schema).schema
        assert "timestamp" in schema or not rows or "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()
