"""A Merkle manifest of a dataset: leaves, subroots of groups, the root, and a proof for every row.

Every level is a self-join of the nodes with their siblings: a node at place i of its group has the slot i mod 8, and
those of slot zero ask for the places i + 1 to i + 7 as far as there are nodes. The rows of slot zero then emit the
parents, with their children's digests. Subroots become the leaves of one more tree. On the way down each parent's row is joined with what its own parent is proved by, so a proof is put
together beside the eight leaves that need it and never shuffled for each of them.

Leaves get their places by a range sort and the counts of its partitions, so a group of any size is many tasks' work.

Defined cases: null values are `-`; a null group comes first; a row without id comes first in its group and is never
tampered with; rows with the same id follow each other by their digests, so equal rows are interchangeable; a lone
leaf is its group's subroot; an empty table gives an empty result; columns that are not named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Children of a node, and hexadecimal characters of a digest.
WIDTH, DIGEST = 8, 64
#: What a leaf's digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Of each value its number of bytes, a colon and itself; '-' for null."""
    shown = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with their place in their group from 0, and the group's size (at, n), by a range sort."""
    sort = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    # Rows of a partition are numbered in their order.
    sort = checkpoint(sort.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}))
    parts = sort.groupBy(group, "part").agg(F.min("nth").alias("least"), F.count("*").alias("many"))
    # One row for each partition that a group is in.
    by = Window.partitionBy(group)
    before = F.coalesce(F.sum("many").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "part", (before - F.col("least")).alias("shift"), F.sum("many").over(by).alias("n"))
    return sort.join(parts, [group, "part"]).withColumn("at", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def _parents(nodes: DataFrame) -> DataFrame:
    """(tree, at, n, lone, digest, children) from nodes (tree, at, n, node: a struct with a digest): n counts a tree's nodes.

    A tree's only node stays what it is: its row has itself as the only child (lone).
    """
    first = nodes.where(F.col("at") % WIDTH == 0).withColumnsRenamed({"at": "zero", "node": "own"})
    offsets = F.filter(F.array(*(F.lit(k).cast("long") for k in range(1, WIDTH))), lambda k: F.col("zero") + k < F.col("n"))
    asked = first.select("tree", "zero", "n", "own", F.explode_outer(offsets).alias("slot")).withColumn("at", F.col("zero") + F.col("slot"))
    siblings = asked.join(nodes.select("tree", "at", "node"), ["tree", "at"], "left")
    whole = siblings.groupBy("tree", "zero").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "node")))).alias("rest"))
    children = F.concat(F.array("own"), F.transform("rest", lambda x: x["node"]))
    whole = whole.select("tree", (F.col("zero") / WIDTH).cast("long").alias("at"), F.ceil(F.col("n") / WIDTH).alias("n"), (F.col("n") == 1).alias("lone"), children.alias("children"))
    joined = F.array_join(F.transform("children", lambda x: x["digest"]), "")
    return whole.withColumn("digest", F.when(F.col("lone"), F.col("children")[0]["digest"]).otherwise(digest(joined)))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """Parents of every level from the lowest, each written; a tree that has its top is in no higher level."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [checkpoint(_parents(leaves))]
    while (most := -(-most // WIDTH)) > 1:
        nodes = levels[-1].where("n > 1").select("tree", "at", "n", F.struct("digest").alias("node"))
        levels.append(checkpoint(_parents(nodes)))
    return levels


_STEP = "array<struct<slot:int,others:string>>"


def _step(slot: Column, children: Column) -> Column:
    """The digests of a child's siblings from left to right, and its slot among them; nothing for a lone node."""
    others = F.array_join(F.transform(F.filter(children, lambda _, i: i != slot), lambda x: x["digest"]), "")
    return F.array(F.struct(slot.cast("int").alias("slot"), others.alias("others")))


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's rows with the steps from them to the root (path), and the columns of tops (tree, path, ...)."""
    extra = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level in reversed(levels):
        found = level.where("n = 1").join(tops, "tree")
        if above is not None:
            up = above.select("tree", F.col("at").alias("up"), F.col("children").alias("aunts"), F.col("path").alias("rest"), *extra)
            mine = level.where("n > 1").withColumn("up", F.floor(F.col("at") / WIDTH)).join(up, ["tree", "up"])
            path = F.concat(_step((F.col("at") % WIDTH).cast("int"), F.col("aunts")), "rest")
            found = found.unionByName(mine.withColumn("path", path).drop("up", "aunts", "rest"))
        above = found
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(own: Column, step: Column) -> Column:
        before = step["slot"] * DIGEST
        return digest(F.concat(F.substring(step["others"], F.lit(1), before), own, F.substring(step["others"], before + 1, F.lit(WIDTH * DIGEST))))

    return F.aggregate(path, leaf, up)


def manifest(leaves: DataFrame, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) from rows (group, order, leaf, tampered).

    tampered: the digest to check in place of the leaf's, null where the leaf itself is.
    """
    named = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit(":"), F.col(group).cast("string")))
    rows = checkpoint(leaves.select(named.alias("tree"), F.col(order).alias("id"), "leaf", "tampered"))
    low = placed(rows, "tree", ["id", "leaf"])
    levels = _levels(checkpoint(low.select("tree", "at", "n", F.struct(F.col("leaf").alias("digest"), "id", "tampered").alias("node"))))
    subroots = reduce(DataFrame.unionByName, (x.where("n = 1").select("tree", "digest") for x in levels))
    # The groups' subroots are the leaves of one more tree.
    high = placed(subroots.select(F.lit("").alias("top"), F.col("tree").alias("id"), F.col("digest").alias("leaf")), "top", ["id"])
    upper = _levels(checkpoint(high.select(F.col("top").alias("tree"), "at", "n", F.struct(F.col("leaf").alias("digest"), "id").alias("node"))))
    roots = reduce(DataFrame.unionByName, (x.where("n = 1").select("tree", F.col("digest").alias("root")) for x in upper))
    tops = _leaf_rows(_paths(upper, roots.withColumn("path", F.array().cast(_STEP))), ["root"])
    tops = checkpoint(tops.select(F.col("node.id").alias("tree"), F.col("node.digest").alias("subroot"), "root", "path"))
    found = _leaf_rows(_paths(levels, tops), ["subroot", "root"])
    fold = folded(F.coalesce("node.tampered", "node.digest"), F.col("path"))
    proof = F.array_join(F.transform("path", lambda x: x["others"]), "")
    found = found.select(F.col("node.id").alias(order), F.col("node.digest").alias("leaf"), "subroot", "root", digest(proof).alias("proof_sha256"), fold.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_rows(lowest: DataFrame, extra: list[str]) -> DataFrame:
    """(node, path, ...) for each child of the lowest level, with its own step first unless it is alone."""
    each = lowest.select("lone", "children", "path", *extra, F.posexplode("children").alias("slot", "node"))
    own = F.when(F.col("lone"), F.array().cast(_STEP)).otherwise(_step(F.col("slot"), F.col("children")))
    return each.select("node", F.concat(own, "path").alias("path"), *extra)


def document_manifest(df: DataFrame) -> DataFrame:
    """manifest() of documents; of a third of them, chosen by their ids' CRC-32, a copy with small letters is checked."""
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = [small if c == "text" else F.col(c) for c in FIELDS]
    return manifest(df.select("lang", "doc_id", leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"), F.when(chosen, leaf_digest(changed)).alias("tampered")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_merkle_manifest: the manifest of all documents, by language."""
    return document_manifest(table(spark, sf_dir, "documents"))
