"""Corpus pipeline: language, toxicity, near-duplicates, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import langid, mixing, packing, simhash, toxicity
from gatehouse.llm import queries as registered
from gatehouse.llm._spark import boxed, materialise, name, sieved, small_batches


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts in none of the learned languages (null, or without a letter) go.

    Rows with a null or repeated doc_id, and repeated rows, are judged one by one.
    """
    judged = langid.identify_languages(boxed(docs, text=F.col("text")), registered.language_model(spark, sf_dir))
    with small_batches(spark):
        return materialise(judged.where(F.col("lang_pred") != langid.UNKNOWN).select("row.*"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: texts that are predicted toxic go.

    Rows with a null or repeated doc_id, and repeated rows, are judged one by
    one; a null or empty text has no word that speaks for toxicity and stays
    unless most learned texts are toxic.
    """
    judged = toxicity.score_toxicity(boxed(docs, text=F.col("text")), registered.toxicity_model(spark, sf_dir))
    with small_batches(spark):
        return materialise(judged.where("predicted = 0").select("row.*"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group one row stays, of those with the smallest doc_id (a null id comes last).

    Near-duplicates have a cosine of at least 0.8 between their sets of 5-word
    shingles (`simhash.near_duplicate_groups`). Rows are told apart by a hash of
    all columns, as ids may be null or repeated; of equal rows one stays. Texts
    that are null or have no word are near-duplicates of each other.
    """
    # The hash skips nulls, so it gets them as flags.
    whole = [x for c in docs.columns for x in (name(c), name(c).isNull())]
    hashes = [F.xxhash64(F.lit(seed), *whole) for seed in (1, 2)]
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), hashes[0].alias("h"), hashes[1].alias("g"))
    keyed = boxed(docs, text=F.col("text"), key=key)
    groups = materialise(simhash.near_duplicate_groups(keyed.select("text", "key")).select("doc_id", "component_id"))
    # Rows that surely lead their group, once, stay where they are; the others are dealt by their hash and looked up.
    others = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("component_id").alias("leader")).where("n > 1 OR doc_id <> leader")
    rows = sieved(keyed.select("row", F.col("key.h").alias("h"), F.col("key.g").alias("g")), "h", others.select("doc_id.h"))
    leaders = groups.where("doc_id = component_id").select(F.col("doc_id.h").alias("h"), F.col("doc_id.g").alias("g")).distinct()
    looked_up = rows.where("maybe").dropDuplicates(["h", "g"]).join(leaders, ["h", "g"], "left_semi")
    return rows.where("NOT maybe").unionByName(looked_up.select(rows.columns)).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix takes it (0 to 2 times).

    A null source is a source, the last one; a null or empty text has no words
    and isn't taken; a null doc_id is an id; repeated rows are documents of
    their own.
    """
    sized = boxed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=mixing.words_in("text"))
    mixed = mixing.mix_to_weights(sized)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return mixed.where("copies > 0").select("row", copies.alias("copy")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of every document and their places in the sequences.

    A null or empty text is one piece of the end token; a null doc_id stays
    null; repeated rows are packed one by one.
    """
    return packing.pack_documents(docs, registered.load_tokenizer)


STAGES = [("language_id", keep_languages), ("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("mixing", mix), ("best_fit_packing", pack)]

#: SQL can't express the models of the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, but for the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
