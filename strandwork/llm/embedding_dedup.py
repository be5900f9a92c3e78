"""Embedding near-dedup: sign hashing by random hyperplanes in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut

#: Least cosine of a link; chance to miss a pair just at it; members that a bucket should have by chance; most vectors of a block.
COSINE, MISS, CHANCE_MEMBERS, BLOCK = 0.93, 0.001, 128, 1024
#: Rows of buckets that make one group of work.
GROUP = 4000
SEED = 4_242


def plan_tables(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits per table and tables: bits grow with the logarithm of the rows of the largest label (30 at most), tables so that a pair at the limit is missed with probability miss."""
    bits = min(30, max(4, math.ceil(math.log2(max(rows, 2) / CHANCE_MEMBERS))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - together))


def clean(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(row, vec_id, label, v, key): the vector (floats stay floats, other numbers become doubles) and a 128-bit hash of label and vector.

    v and key are null where the vector can't link: a null or empty vector or label, a null or non-finite part, all zeros.
    """
    v = F.col(embedding) if dict(vectors.dtypes)[embedding] == "array<float>" else F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = (F.size(v) > 0) & F.col(label).isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.when(ok, v).alias("v"))
    key = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "v")), 16, "0") for k in (SEED, SEED + 1)]))
    return rows.withColumn("key", F.when(F.col("v").isNotNull(), key)).withColumn("row", F.monotonically_increasing_id())


def signer(bits: int, tables: int):
    """Arrow function: (node, label, v, copies) to one row per table with the bucket and the packed signs of all tables."""
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            node, label, v, copies = batch.columns
            lengths = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
            signs = np.zeros((len(batch), tables * bits), bool)
            for width in np.unique(lengths):  # vectors of one length are compared only with each other
                if int(width) not in planes:
                    planes[int(width)] = np.random.default_rng((SEED, int(width))).standard_normal((int(width), bits * tables))
                at = np.flatnonzero(lengths == width)
                x = np.stack([flat[ends[i] : ends[i + 1]] for i in at]).astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                signs[at] = x @ planes[int(width)] > 0
            keys = (signs.reshape(len(batch), tables, bits).astype(np.int64) << np.arange(bits)[None, None]).sum(axis=2)
            packed = pa.array([row.tobytes() for row in np.packbits(signs, axis=1)], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([node, label, v, copies, pa.array(lengths, pa.int32()), pa.array(np.full(len(batch), t, np.int32)), pa.array(keys[:, t].copy()), packed], names=["node", "label", "v", "copies", "width", "table", "bucket", "signs"])

    return signs


def bucket_links(rows: pa.Table, cosine: float, bits: int, tables: int) -> pa.Table:
    """For the buckets, or pairs of blocks of buckets, of one group: each vector's number of linked vectors (copies counted) that met in no earlier table, and edges that span the links."""
    number = lambda c: rows.column(c).to_numpy()
    node, width, table, bucket, block, low, high, copies = (number(c) for c in ("node", "width", "table", "bucket", "block", "low", "high", "copies"))
    label = np.unique(np.array(rows.column("label").to_pylist()), return_inverse=True)[1]
    v = rows.column("v").combine_chunks()
    flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))))
    packed = np.frombuffer(b"".join(rows.column("signs").to_pylist()), np.uint8).reshape(len(node), -1)
    parts = (high, low, bucket, table, width, label)
    order = np.lexsort((node, *parts))
    change = np.zeros(len(order), bool)
    for p in parts:
        change[1:] |= p[order][1:] != p[order][:-1]
    nodes, links, roots = [], [], []
    for at in np.split(order, np.flatnonzero(change)):
        if len(at) < 2:
            continue
        x = np.stack([flat[ends[i] : ends[i + 1]] for i in at]).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if low[at[0]] != high[at[0]]:  # within a block its own pair counts
            linked &= block[at][:, None] != block[at][None, :]
        u, w = np.nonzero(linked)
        earlier = int(table[at[0]])
        if len(u) and earlier:
            signs = np.unpackbits(packed[at], axis=1, count=bits * tables).reshape(len(at), tables, bits)[:, :earlier]
            keys = (signs.astype(np.int64) << np.arange(bits)[None, None]).sum(axis=2)
            new = np.concatenate([~(keys[u[i : i + 65536]] == keys[w[i : i + 65536]]).any(axis=1) for i in range(0, len(u), 65536)])
            u, w = u[new], w[new]
        if not len(u):
            continue
        near = np.arange(len(at))
        while True:  # smallest linked place, again and again: all in this one bounded bucket
            label_of = near.copy()
            np.minimum.at(near, u, label_of[w])
            near = near[near]
            if (near == label_of).all():
                break
        count = np.bincount(u, weights=copies[at][w], minlength=len(at)).astype(np.int64)
        some = count > 0
        nodes.append(node[at][some])
        links.append(count[some])
        roots.append(node[at][near][some])
    whole = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return pa.table({"node": whole(nodes), "links": whole(links), "root": whole(roots)})


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id (smallest vec_id reachable over links) and kept (vec_id = component_id).

    Vectors with equal, non-null labels and equal lengths are linked if their cosine (doubles) is at least
    `cosine`. Null, empty and all-zero vectors, and such with null or non-finite parts, link with nothing.
    Exact copies (equal 128-bit hashes) are one node with a count, so they cost one row, and count as each other's
    links. Repeated rows are copies. Nodes that share a bucket of some table are compared exactly; a pair counts in the first table
    where it meets, so each link once. A bucket of any size is dealt to blocks, and each pair of blocks is one
    group of at most about 2 * BLOCK vectors: no task gets a whole large bucket, and no pair is a row. A pair
    just at the limit is missed with probability MISS. Per table a node shuffles its vector (floats as floats) and
    its packed signs, once for each block that it is compared with; buckets of CHANCE_MEMBERS keep the tables few.
    """
    rows = cut(clean(vectors, vec_id, embedding, label), "vectors")
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count("row").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = cut(nodes, "vector-nodes")
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan_tables(largest, cosine)
    kind = dict(nodes.dtypes)
    signed = nodes.select("node", "label", "v", "copies").mapInArrow(signer(bits, tables), f"node long, label {kind['label']}, v {kind['v']}, copies long, width int, table int, bucket long, signs binary")
    key = ["table", "bucket", "label", "width"]
    large = cut(signed.groupBy(*key).agg(F.count("node").alias("members")).where(F.col("members") > BLOCK).select(*key, F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "vector-buckets")
    met = signed.withColumn("blocks", F.lit(1)) if large.isEmpty() else signed.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("with", "blocks")
    # Many small buckets make one group, so that a group is about GROUP rows of work.
    groups = max(1, math.ceil(nodes.count() * tables / GROUP))
    met = met.withColumn("group", F.pmod(F.xxhash64(*key, "low", "high"), F.lit(groups)))
    found = met.groupBy("group").applyInArrow(lambda rows: bucket_links(rows.drop(["group"]), cosine, bits, tables), "node long, links long, root long")
    found = cut(found, "vector-links")
    labels = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "vector")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.join(counted, "node", "left").join(labels.select(F.col("node").alias("n"), "component"), F.col("node") == F.col("n"), "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = joined.join(smallest, "component").select(F.col("key").alias("node_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.drop("v", "label").join(known, F.col("key") == F.col("node_key"), "left")
    smallest_id = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), smallest_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
