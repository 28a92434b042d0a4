"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: A node's links are dealt over so many keys, so that one with very many is not one task's work.
SALTS = 8


def _nearest(links: DataFrame) -> DataFrame:
    """(u, v, m): each link with the smallest node among u and all of u's partners."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v: long), component being the smallest node reachable.

    Each round is joins and grouped minima over all links, cut by a checkpoint; rounds end when nothing changes.
    Loops and repeated links do no harm; without links the result is empty.
    """
    links = checkpoint(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _nearest(large)
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        links = checkpoint(near.select(F.explode(pairs).alias("p")).select("p.*").where("u != v").distinct())
    ends = links.groupBy("u").agg(F.min("v").alias("v"))
    return ends.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the given ones, at most one for each node: to the smallest node reachable."""
    if not len(u):
        return u, v
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]
