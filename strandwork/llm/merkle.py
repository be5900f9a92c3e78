"""Merkle manifest of a dataset: a hash tree per group and over groups, with a proof for every row, by butterfly exchange between blocks of leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, cut

#: Children of a node; levels of the tree that lie within one block of leaves, which one task hashes.
FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(value: Column) -> Column:
    """A value as it is hashed: - for null, else the UTF-8 bytes of its text, a colon, and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[spelled(f) for f in fields]), 256)


def levels_up(leaves: Sequence[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of `levels` levels above the leaves, the leaves first: every run of `fanout` nodes, the last one too if it is shorter, becomes its hash."""
    out = [list(leaves)]
    for _ in range(levels):
        below = out[-1]
        out.append([sha(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def depth(n: Column, fanout: int = FANOUT, most: int = LEVELS) -> Column:
    """Levels above n leaves until one node is left, `most` at most."""
    d: Column = F.lit(most)
    for k in range(most - 1, -1, -1):
        d = F.when(n <= fanout**k, F.lit(k)).otherwise(d)
    return d


def placed(leaves: DataFrame, group: str, order: Sequence[Column], size: int) -> DataFrame:
    """leaves plus pos (from 0 in its group, by order), total (leaves of the group) and block (pos div size).

    Range partitions, sorted within, numbered as they lie; each number is then moved to its group's count by the rows of the
    partitions before, of which there is one row per group and partition. So no group is sorted in one place. Rows alike
    in all of `order` are dealt by where they are read from.
    """
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_read").asc()]
    dealt = leaves.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_read"), "leaves")
    part = F.shiftright("_at", 33)
    parts = dealt.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("total"))
    numbered = dealt.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_part")))
    return numbered.withColumn("pos", F.col("_at") + F.col("_shift")).withColumn("block", F.expr(f"pos div {size}")).drop("_g", "_part", "_shift", "_at")


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, i, root, above) for nodes (tree, i, n, node): the n nodes of one level of each tree, i from 0.

    above is an array of (left, right): at each level from here to the root, the hashes beside the node's ancestor, joined. In
    round r the nodes lie in subtrees of fanout^r; each node meets the ones at the same place of the other subtrees of
    its parent, fanout at most, takes their roots and hashes the parent itself. So after the last round each node has hashed all its ancestors
    and holds its whole proof, and nothing is sent down again. A last subtree that is not full has no node at some
    places: its nodes take turns in standing there. Each round is one shuffle of the nodes; their number is that of blocks.
    """
    state = nodes.select("tree", F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"), "node", F.array().cast("array<struct<left:string,right:string>>").alias("above"))
    most, width = nodes.agg(F.max("n")).first()[0] or 0, 1
    while width < most:
        below = f"(n - (i div {width}) * {width})"  # nodes from the begin of this subtree to the end of its tree
        full = F.least(F.lit(width).cast("long"), F.expr(below))
        own = F.expr(f"i % {width}")
        alone = F.expr(f"(i div {width}) % {fanout} = 0 and n <= (i div {width} + 1) * {width}")
        places = F.when(alone, F.array(own)).otherwise(F.sequence(own, F.lit(width - 1).cast("long"), full))
        sent = state.withColumns({"_up": F.expr(f"i div {width * fanout}"), "_digit": F.expr(f"(i div {width}) % {fanout}"), "_own": own}).withColumn("_place", F.explode(places))
        met = Window.partitionBy("tree", "_up", "_place").orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sent = sent.withColumn("_met", F.collect_list(F.struct("_digit", "node")).over(met)).where("_place = _own")
        side = lambda keep: F.array_join(F.transform(F.filter("_met", keep), lambda m: m["node"]), "")
        beside = F.struct(side(lambda m: m["_digit"] < F.col("_digit")).alias("left"), side(lambda m: m["_digit"] > F.col("_digit")).alias("right"))
        going = F.col("n") > width
        parent = F.sha2(F.array_join(F.transform("_met", lambda m: m["node"]), ""), 256)
        state = sent.select("tree", "i", "n", F.when(going, parent).otherwise(F.col("node")).alias("node"), F.when(going, F.array_append("above", beside)).otherwise(F.col("above")).alias("above"))
        width *= fanout
    return state.select("tree", "i", F.col("node").alias("root"), "above")


def block_roots(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(group_name, block, n, node): the root of each block of leaves and the blocks of its group. A group of one block ends where one node is left."""
    size = fanout**levels

    def root(key: tuple, leaves: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("pos")
        return pd.DataFrame({"group_name": [leaves["group_name"].iloc[0]], "block": [leaves["block"].iloc[0]], "n": [-(-int(leaves["total"].iloc[0]) // size)], "node": [levels_up(leaves["leaf"].tolist(), int(leaves["levels"].iloc[0]), fanout)[-1][0]]})

    return rows.select("group_name", "block", "pos", "total", "levels", "leaf").groupBy("group_name", "block").applyInPandas(root, "group_name string, block long, n long, node string")


def proofs(rows: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """Rows of blocks (group_name, block, pos, levels, leaf, seen, the id) joined with what their block got in the exchange: subroot, root, proof, fold."""
    def fold(node: str, path: Sequence[tuple[str, str]]) -> str:
        for left, right in path:
            node = sha(left, node, right)
        return node

    def proven(leaves: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        leaves, top = leaves.sort_values("pos"), top.iloc[0]
        levels = levels_up(leaves["leaf"].tolist(), int(leaves["levels"].iloc[0]), fanout)
        upper = [(x["left"], x["right"]) for x in top["above"]]
        out = []
        for i, seen in enumerate(leaves["seen"].tolist()):
            path, k = [], i
            for nodes in levels[:-1]:
                a = k - k % fanout
                path.append(("".join(nodes[a:k]), "".join(nodes[k + 1 : a + fanout])))
                k //= fanout
            path += upper
            out.append((sha(*[x for beside in path for x in beside]), fold(seen, path)))
        return pd.DataFrame({"id": leaves["id"], "leaf": leaves["leaf"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": [p for p, _ in out], "folded_root": [f for _, f in out], "verified": [f == top["root"] for _, f in out]})

    kind = dict(rows.dtypes)["id"]
    a = rows.select("group_name", "block", "pos", "levels", "leaf", "seen", "id")
    b = above.select(F.col("group_name").alias("g"), F.col("block").alias("b"), "subroot", "root", "above")
    return a.groupBy("group_name", "block").cogroup(b.groupBy("g", "b")).applyInPandas(lambda x, y: proven(x, y) if len(x) else pd.DataFrame(columns=OUT), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


OUT = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", doc_id: str = "doc_id", seen: Sequence[Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of docs.

    A row's leaf is the hash of its fields. Leaves of a group lie by doc_id (null first), those of one doc_id by
    their hash; runs of `fanout` become their hash until one node, the group's subroot, is left; subroots by group (null first)
    give the root likewise. proof_sha256 is the hash of all siblings from leaf to root; folded_root is what they and the hash of `seen`
    (the fields as they are found now; by default as they were) fold to; verified tells whether that is the root.

    Texts are hashed where they are read and never shuffled: 32 bytes as hex go on. A block of fanout^levels leaves is hashed
    in one task, however large its group; blocks exchange their roots by butterfly(), then prove their rows. Empty tables give no rows;
    null fields have a spelling of their own; equal rows have equal leaves and a proof each; extra columns are not read.
    """
    own = [F.col(f) for f in fields]
    rows = docs.select(F.col(group).cast("string").alias("group_name"), F.col(doc_id).alias("id"), leaf_hash(own).alias("leaf"), leaf_hash(seen or own).alias("seen"))
    rows = placed(rows, "group_name", [F.col("id").asc_nulls_first(), F.col("leaf").asc()], fanout**levels)
    rows = rows.withColumn("levels", depth(F.col("total"), fanout, levels))
    roots = cut(block_roots(rows, fanout, levels), "roots")
    # Within each group; a null group is told from an empty one.
    tree = F.coalesce(F.concat(F.lit("="), "group_name"), F.lit(""))
    inner = cut(butterfly(roots.select(tree.alias("tree"), F.col("block").alias("i"), "n", "node"), fanout), "inner")
    # Over groups: their order is that of `tree`, in which null lies first.
    tops = placed(inner.where("i = 0").select(F.lit(None).cast("string").alias("all_groups"), "tree", F.col("root").alias("subroot")), "all_groups", [F.col("tree").asc()], 1)
    outer = butterfly(tops.select(F.lit("").alias("tree"), F.col("pos").alias("i"), F.col("total").alias("n"), F.col("subroot").alias("node")), fanout)
    outer = cut(outer.join(tops.select(F.col("pos").alias("i"), F.col("tree").alias("t"), "subroot"), "i").select("t", "subroot", "root", F.col("above").alias("outer")), "outer")
    above = inner.join(outer, F.col("tree") == F.col("t")).select(F.when(F.col("tree") != "", F.expr("substr(tree, 2)")).alias("group_name"), F.col("i").alias("block"), "subroot", outer["root"].alias("root"), F.concat("above", "outer").alias("above"))
    return proofs(rows, above, fanout).withColumnRenamed("id", doc_id)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; where 3 divides the crc32 of doc_id, its text is found with A-Z lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(hit & F.col("text").rlike(f"[{UPPER}]"), ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, seen=[F.col(f) if f != "text" else text for f in FIELDS])
