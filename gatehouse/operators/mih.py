"""Exact nearest codes by multi-index hashing (Norouzi, Punjani and Fleet, 2012), as equality joins.

A code is cut into substrings of 16 bits. Two codes that differ in under
m * (r + 1) bits differ in at most r bits in one of the m substrings. So a query
that has met all codes of which a substring differs in at most r bits knows all
its neighbours nearer than m * (r + 1), and is done once its k-th one is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..plans.tables import written

BITS = 16


def substrings(code: str) -> Column:
    """array<struct<no, value>>: the 16-bit parts of a binary code."""
    parts = lambda w, i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct((i * 4 + j).alias("no"), F.call_function("shiftrightunsigned", w, 48 - 16 * j).bitwiseAND(F.lit(0xFFFF)).alias("value")))
    return F.flatten(F.transform(code, parts))


def nearest(codes: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(query_id, key, far, rank) of the k nearest codes of each query, ties by key; and per query, how many were looked at.

    codes: key, bin. queries: query_id (distinct), bin. Equal codes are one in
    the buckets, with their k least keys. In each round the queries that aren't
    done meet the buckets whose value differs in exactly as many bits as the
    round says; the best k of each query are written, so a round reads no more
    than those and its own buckets. The second result is (query_id, rounds, looked_at, codes).
    """
    spark = codes.sparkSession
    numbered = codes.where(f"bin IS NOT NULL AND {key} IS NOT NULL").select(F.xxhash64("bin").alias("code"), "bin", key)
    members = written(numbered.withColumn("_n", F.row_number().over(Window.partitionBy("code", "bin").orderBy(key))).where(F.col("_n") <= k).drop("_n"), "mih-members")
    distinct = written(members.select("code", "bin").distinct(), "mih-codes")
    buckets = written(distinct.select("code", "bin", F.inline(substrings("bin"))), "mih-buckets")
    total, parts = distinct.count(), F.size("bin") * 4
    #: Which bits differ, by how many: 65,536 rows, whatever is asked.
    masks = spark.range(1 << BITS).select(F.col("id").alias("mask"), F.bit_count("id").alias("radius"))
    open_, best, looked = written(queries.select("query_id", "bin"), "mih-open"), None, None
    for radius in range(BITS + 1):
        probes = open_.select("query_id", F.col("bin").alias("of"), F.inline(substrings("bin")), F.lit(radius).alias("radius")).join(F.broadcast(masks), "radius").select("query_id", "of", "no", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        met = probes.join(buckets, ["no", "value"]).select("query_id", "code", vectors.hamming("bin", "of").alias("far")).distinct()
        met = written(met, "mih-met")
        seen = met.groupBy("query_id").agg(F.count("*").alias("n"))
        looked = seen if looked is None else looked.unionByName(seen)
        pool = met if best is None else best.select("query_id", "code", "far").unionByName(met).distinct()
        order = Window.partitionBy("query_id").orderBy("far", "code")
        at_edge = pool.withColumn("_n", F.dense_rank().over(Window.partitionBy("query_id").orderBy("far"))).withColumn("_r", F.row_number().over(order))
        # Codes as far as the k-th one stay too, as a tie is broken by the key.
        edge = F.max(F.when(F.col("_r") <= k, F.col("_n"))).over(Window.partitionBy("query_id"))
        best = written(at_edge.withColumn("_e", edge).where("_n <= _e").select("query_id", "code", "far", "_r"), "mih-best")
        kth = best.where(F.col("_r") == k).select("query_id", F.col("far").alias("kth"))
        left = open_.join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("kth") >= parts * (radius + 1)))
        done = open_.select("query_id").join(left.select("query_id"), "query_id", "left_anti").select("query_id", F.lit(radius + 1).alias("rounds"))
        open_ = written(left.select("query_id", "bin"), "mih-open")
        rounds = done if radius == 0 else rounds.unionByName(done)
        if open_.isEmpty():
            break
    ranked = best.join(members.select("code", key), "code").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("far", key)))
    read = looked.groupBy("query_id").agg(F.sum("n").alias("looked_at")).join(rounds, "query_id", "left").withColumn("codes", F.lit(total))
    return ranked.where(F.col("rank") <= k).select("query_id", key, "far", "rank"), read
