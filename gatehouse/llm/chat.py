"""Chat rendering after the collapse of cumulative conversation snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: One rendered turn; the names of the marks are those of common chat templates.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


def distinct_turns(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text), each once and dealt by conv, which names a conversation.

    A row without a conv_id is a conversation of its own, named by what is in it.
    """
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64(F.col("turn").isNull(), "turn", *_seen()))
    turns = conversations.select(F.struct("conv_id", alone.alias("alone")).alias("conv"), "conv_id", "turn", "role", "text")
    # Dealt by conversation first: equal rows meet there, and the windows need no other exchange.
    return turns.repartition("conv").distinct()


def _seen() -> list:
    """What makes turns equal. Hashes skip nulls, so they get them as flags."""
    return [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn of `distinct_turns`: conv, pos (from 1), n_turns and the prefix hash (h0, h1) up to that turn.

    Turns are ordered by turn (null last), role and text. The hash of a prefix
    is the xor of its turns' hashes, each salted with the turn's position, in
    two independent 64-bit lanes. Xor of salted hashes rolls, so a running
    window yields every prefix of a conversation in one pass.
    """
    by_turn = Window.partitionBy("conv").orderBy(*[F.col(c).asc_nulls_last() for c in ("turn", "role", "text")])
    lanes = [F.xxhash64(F.lit(seed), *_seen()).alias(f"lane{i}") for i, seed in enumerate((42, 7919))]
    numbered = turns.select("*", F.row_number().over(by_turn).alias("pos")).select("conv", "conv_id", "pos", *lanes)
    running = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.select("conv", "conv_id", "pos", F.max("pos").over(Window.partitionBy("conv")).cast("long").alias("n_turns"), *[F.bit_xor(F.xxhash64("pos", f"lane{i}")).over(running).alias(f"h{i}") for i in range(2)])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies) of the conversations that no longer one starts with.

    Of conversations with the same turns the smallest conv_id stays (null last);
    n_copies counts them all. Strict prefixes are made distinct before the
    anti-join (with partial aggregation), so a first turn that a third of the
    conversations share is one row there.
    """
    prefixes = turn_prefixes(turns)
    first = F.min_by("conv", F.struct(F.col("conv_id").isNull(), "conv_id"))
    whole = prefixes.where("pos = n_turns").groupBy("n_turns", "h0", "h1").agg(first.alias("conv"), F.count("*").alias("n_copies"))
    starts = prefixes.where("pos < n_turns").select(F.col("pos").cast("long").alias("n_turns"), "h0", "h1").distinct()
    return whole.join(starts, ["n_turns", "h0", "h1"], "left_anti").select("conv", "n_turns", "n_copies")


def render_chats(conversations: DataFrame) -> DataFrame:
    """Render every maximal conversation: conv_id, n_turns, n_copies and text.

    Input: conv_id, turn, role, text; other columns are ignored. Turns are
    taken in the order of turn (null last), then role, then text. A repeated
    row counts once. A row with a null conv_id is a conversation of one turn. A
    null role or text renders as an empty string but differs from one in the
    comparison. The empty table gives the empty table. A conversation becomes
    one row, so its turns have to fit into one.
    """
    turns = distinct_turns(conversations)
    kept = maximal_conversations(turns).withColumnRenamed("conv", "kept")
    mine = turns.join(kept, F.col("conv").eqNullSafe(F.col("kept")))
    # Sorting structs puts nulls first, hence the flags that put them last.
    entry = F.struct(F.col("turn").isNull().alias("a"), F.col("turn").alias("b"), F.col("role").isNull().alias("c"), F.col("role").alias("d"), F.col("text").isNull().alias("e"), F.col("text").alias("f"))
    body = F.transform(F.array_sort(F.collect_list(entry)), lambda t: F.concat(F.lit(TURN_START), F.coalesce(t["d"], F.lit("")), F.lit("\n"), F.coalesce(t["f"], F.lit("")), F.lit(TURN_END)))
    return mine.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(body, "").alias("text")).drop("conv")
