"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from linewright.llm.base import cut, join_groups

#: Different links of 16 bytes that the driver may join; the rounds for more of them leave it with more plans than that.
DRIVER_LINKS = 100_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links between numbers, sorted, and the least node that can be reached from each."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _stars(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link each neighbour to the least of the node and its neighbours; pairs are (node, neighbour)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_lw_m"), F.count("*").alias("n")).select("u", F.least("u", "_lw_m").alias("m"), "n")
    joined = join_groups(pairs, least, "u", "n")
    if larger_only:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.filter("m < u").select("u", F.col("m").alias("v"))
    return joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b), the least node that can be reached from it.

    Self-links and repeated links do no harm; a node without links has no row; nulls are ignored. Each round
    is two joins on the node. Minima are aggregated before their shuffle, and the links of a hub stay where they
    are (see join_groups), so none is dealt to one task. Rounds end when the links stay as they are, after about
    the logarithm of the longest path. Up to DRIVER_LINKS different links between longs need no rounds: the driver
    joins them.
    """
    edges = (
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    edges = cut(edges)
    if edges.schema["u"].dataType == LongType() and edges.count() <= DRIVER_LINKS:
        few = edges.toArrow()
        nodes, roots = least_reachable(few["u"].to_numpy(), few["v"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())}))
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True).filter("u <> v").distinct()
        edges = cut(_stars(large, False).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(now)
