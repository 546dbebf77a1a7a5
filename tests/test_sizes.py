"""Work that grows no faster than the input, with the results of plainer ways."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse.functions import text, vectors
from gatehouse.operators import index as ix
from gatehouse.operators import topk
from gatehouse.plans.shape import executed_plan


def test_ranges_are_fitted_in_tasks_over_lengths_taken_once(spark):
    rows = [([3.0, None, -1.0, None],), ([0.5, 2.0, float("nan"), None],), (None,), ([7.0, 2.0, 4.0, None],)]
    frame = spark.createDataFrame(rows, "vector array<float>").repartition(3)
    q = ix.fit_int8(frame).first() if frame.first()[0] else ix.fit_int8(frame, dimension=4).first()
    assert q["minimum"] == [0.5, 2.0, -1.0, None] and q["scale"][:2] == [6.5, 1.0] and np.isnan(q["scale"][2]) and q["scale"][3] is None
    plan = executed_plan(ix.fit_int8(frame.select(vectors.l2_normalize("vector").alias("vector")), dimension=4))
    assert "MapInArrow" in plan
    # The length isn't computed for each component: no function of a component holds it.
    made = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("v"))
    text = made.select(vectors.l2_normalize("v").alias("u"))._jdf.queryExecution().analyzed().toString()
    assert "/ CASE" not in text and made.select(vectors.l2_normalize("v")).first()[0] == [0.6, 0.8]


def test_histograms_of_ranges_count_every_component(spark):
    frame = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],), ([-1.0, 0.0],)], "vector array<double>").repartition(2)
    quant = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0], 2)], "minimum array<double>, scale array<double>, dimension int")
    got = {r["dimension"]: r["cells"] for r in ix.range_histograms(frame, quant).collect()}
    assert got[0] == [1, 1, *[0] * 14, 1, 0] and got[1] == [0, 2, *[0] * 14, 1, 0]


TEXTS = ["", None, "Hello, hello World 42", "a", "b b b", "x" * 90, "one two  one two\u212a", ""]


@pytest.mark.parametrize("at_once", [4 << 20, 8])
def test_features_are_counted_in_tasks(spark, at_once, monkeypatch):
    monkeypatch.setattr(text, "BYTES_AT_ONCE", at_once)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").coalesce(1)
    grams = {"words": lambda w: w, "pairs": lambda w: [" ".join(p) for p in zip(w, w[1:], strict=False)], "trigrams": lambda w: ["#" + f" {x} "[i : i + 3] for x in w for i in range(len(x))]}
    for kind, of in grams.items():
        found = text.counted(frame, "i", kind)
        assert "MapInArrow" in executed_plan(found) and "Aggregate" not in executed_plan(found)
        want = {i: Counter(of(re.findall("[a-z0-9]+", (t or "").lower()))) for i, t in enumerate(TEXTS)}
        assert sorted(map(tuple, found.collect())) == sorted((i, f, n) for i, c in want.items() for f, n in c.items())
    native = frame.select("i", F.explode(text.ngram_features("text")).alias("f")).withColumn("h", F.crc32(F.col("f").cast("binary")))
    summed = native.groupBy("i", (F.col("h") % 8).alias("b")).agg(F.sum(F.when(F.col("h") >= 1 << 31, 1).otherwise(-1)).alias("v"))
    assert sorted(map(tuple, text.hashed_features(frame, "i", 8).collect())) == sorted(map(tuple, summed.collect()))


def test_one_row_group_is_spread_however_many_parts_its_file_has(spark, tmp_path):
    spark.range(4000).withColumn("t", F.repeat(F.sha2(F.col("id").cast("string"), 256), 20)).coalesce(1).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = spark.read.parquet(f"{tmp_path}/t")
        assert rows.rdd.getNumPartitions() >= 4
        sizes = [r["count"] for r in text.spread(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(sizes) >= 4 and max(sizes) <= 2 * 4000 / 4 and sum(sizes) == 4000


def test_every_score_equals_the_folded_sum(spark):
    rng = np.random.default_rng(4)
    codes, w = rng.integers(-128, 128, (70, 5)), rng.normal(size=(3, 5))
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "vec_id long, i8 array<tinyint>").repartition(3)
    asked = spark.createDataFrame([(i, w[i].tolist(), float(i)) for i in range(3)], "query_id long, weights array<double>, bias double")
    found = topk.every_score(rows, asked, key="vec_id", digits=6)
    assert "MapInArrow" in executed_plan(found) and "Join" not in executed_plan(found)
    both = rows.crossJoin(asked).select("query_id", "vec_id", F.round(vectors.rescore("i8", "weights", F.col("bias")), 6).alias("score"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, both.collect()))
    assert topk.rounded(np.array([0.5, 1.5, -0.5, 2.4, np.inf]), 0).tolist() == [1.0, 2.0, -1.0, 2.0, np.inf]


def test_what_a_task_keeps_for_its_queries_is_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i:03d}", [i % 7, 0]) for i in range(90)], "key string, bin array<long>").repartition(3)
    asked = spark.createDataFrame([(i, [i, 0]) for i in range(12)], "query_id long, bin array<long>")
    best = lambda: sorted(map(tuple, topk.k_best(rows, asked, 5, topk.nearest_codes, key="key", order="far long").collect()))
    want, most = best(), []
    # The bytes for two queries of 5 rows with keys of 4 characters.
    monkeypatch.setattr(topk, "KEPT_BYTES", 2 * 5 * 32, raising=False)
    whole = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda these: most.append(len(these)) or whole(these))
    assert best() == want and sum(most) == 12 and max(most) < 8
