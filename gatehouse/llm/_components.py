"""Connected components of links, as Spark jobs over the links alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the least one of its component, in place of the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if np.array_equal(label, before):
            break
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[far]], nodes[far]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b) reaches.

    Large-star and small-star rounds (Kiveris et al., 2014) until the links
    are stars: about log(n) rounds, each one or two aggregations and joins over
    the links, each written to a table. Nodes without links aren't returned.
    """
    spark = links.sparkSession
    stars = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while state[0]:
        # Large star: a node's larger neighbours move to its least neighbour.
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v")
        # Small star: a node's smaller neighbours, and itself, move to the least of them.
        large = large.distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").unionByName(down.select("v", F.col("m").alias("u")))
        stars = materialise(small.distinct())
        new = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(new) == tuple(state):
            break
        state = new
    ends = stars.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return ends.unionByName(roots)
