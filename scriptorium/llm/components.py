"""Connected components of a table of links, without bringing links to the driver.

Alternates the two star steps of the MapReduce algorithm of Kiveris et al. ("Connected Components in MapReduce and Beyond",
2014): a large star links every greater neighbour of a node to the least one, a small star every lesser neighbour.  Both are
a groupBy with a map-side minimum and a join; a hub's neighbours stay separate rows and are never gathered into one.  Each
round is written to the checkpoint folder; rounds grow with the logarithm of the longest chain.

As soon as at most ``MOST_IN_ONE`` different links are left, 4 MB of them, one task settles them all: a round costs some 15
stages of as many tasks as there are shuffle partitions, all of which the driver plans and keeps account of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.shared import use_checkpoint_dir, written

#: So many links are settled by one task; more go through rounds.
MOST_IN_ONE = 1 << 18


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (parent[a] != parent[b]).any():
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [[batch.column(c).to_numpy(zero_copy_only=False) for c in "ab"] for batch in batches]
    if links:
        found = roots_of(*(np.concatenate(x) for x in zip(*links, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "root"])


def connect(links: DataFrame, *, most_rounds: int = 60, most_in_one: int = MOST_IN_ONE) -> DataFrame:
    """links: a, b (long).  Returns (node, root) for every node of a link; root is the least node that it reaches."""
    use_checkpoint_dir(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct())
    for _ in range(most_rounds):
        n = edges.count()
        if n <= most_in_one:
            return written(edges.coalesce(1).mapInArrow(_settled, "node long, root long"))
        nodes = edges.agg(F.count_distinct("a")).first()[0]
        if n == nodes and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break  # every node has one link, to a node that has none: stars about the least nodes
        # large star: every neighbour above a node goes to the least of the node and its neighbours
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # so that a hub's rows can be split
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lesser neighbours go to the least of those
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = written(large.join(low, "a").select(F.explode(pair).alias("e")).select("e.*").where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
