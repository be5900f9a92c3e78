"""MinHash near-dedup: b-bit signatures, bands for candidates, exact links on whole shingle sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, components, cut, words

#: Bands of ROWS minima each; bits kept of each minimum; a pair at similarity s meets in some band with probability 1 - (1 - s^ROWS)^BANDS.
BANDS, ROWS, BITS = 28, 5, 4
HASHES = BANDS * ROWS
#: Candidates whose estimate is below the threshold by more than this many standard errors are not confirmed.
SIGMAS = 4.5
#: Buckets of more members than SMALL are joined in blocks of BLOCK documents.
SMALL, BLOCK = 24, 512
#: Keys that more than one in HOT rows have are broadcast to those rows: HOT of them at most.
HOT = 10_000
SEED = 20_240_531


def place(doc_id: str, text: str) -> Column:
    return F.xxhash64(doc_id, text)


def shingled(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, at, sh, nid): the sorted distinct 64-bit hashes of the word n-grams of the lower-cased (A-Z) text, and a 128-bit key of that set.

    `at` is a hash of id and text, by which a row is found again. A text of fewer than n words gives its whole sequence as one shingle; one without words an empty set and no key.
    """
    df = docs.select(F.col(doc_id).alias("doc_id"), place(doc_id, text).alias("at"), words(ascii_lower(F.col(text))).alias("w"))
    hashes = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(n)])))
    df = df.withColumn("sh", F.coalesce(hashes, F.when(F.size("w") > 0, F.array(F.xxhash64("w"))), F.array().cast("array<long>"))).drop("w")
    df = df.withColumn("sh", F.sort_array(F.array_distinct("sh")))
    key = F.unhex(F.concat(F.lpad(F.hex(F.xxhash64("sh")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(SEED), "sh")), 16, "0")))
    return df.withColumn("nid", F.when(F.size("sh") > 0, key))


def minhash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set: HASHES minima of multiply-add hashes, packed to their low BITS (sig: longs), and one hash per band of whole minima."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b, mix = rng.integers(0, 2**63, HASHES, dtype=np.uint64), rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    per_long = 64 // BITS
    n_longs = -(-HASHES // per_long)
    for batch in batches:
        sets = batch.column(batch.schema.get_field_index("sh"))
        flat, ends = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))))
        minima = np.zeros((len(batch), HASHES), np.uint64)
        for i in range(len(batch)):
            x = flat[ends[i] : ends[i + 1]]
            for at in range(0, len(x), 1024):  # bounded memory for very long texts
                # the high half of the product depends on all bits; bits are mixed down so that minima's low bits are even
                y = x[at : at + 1024, None] * a[None, :] + b[None, :]
                y ^= y >> np.uint64(32)
                y = y.min(axis=0)
                minima[i] = y if at == 0 else np.minimum(minima[i], y)
        mixed = (minima ^ (minima >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bands = ((mixed.reshape(-1, BANDS, ROWS) * mix[None]).sum(axis=2, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)) * np.uint64(0x94D049BB133111EB) + np.arange(BANDS, dtype=np.uint64)
        low = np.zeros((len(batch), n_longs * per_long), np.uint64)
        low[:, :HASHES] = (mixed >> np.uint64(40)) & np.uint64(2**BITS - 1)
        sig = (low.reshape(len(batch), n_longs, per_long) << (np.arange(per_long, dtype=np.uint64) * np.uint64(BITS))[None, None]).sum(axis=2, dtype=np.uint64)
        as_list = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.reshape(-1).view(np.int64)))
        rest = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "at", "nid", "n_shingles")]
        yield pa.RecordBatch.from_arrays([*rest, as_list(sig), as_list(bands)], names=["doc_id", "at", "nid", "n_shingles", "sig", "bands"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two packed signatures: the share of equal BITS-bit parts, corrected for chance by 1 / 2^BITS."""
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for k in range(1, BITS):
            z = z.bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), k))
        return F.bit_count(z.bitwiseAND(F.lit(ones).cast("long")))

    share = 1 - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, v: s + v) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def block_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges that span the links (exact, on whole sets) among the documents of two blocks: a tree per group of linked documents."""
    frames = pd.concat([left[["nid", "sh"]], right[["o_nid", "o_sh"]].set_axis(["nid", "sh"], axis=1)]).drop_duplicates("nid")
    if frames.empty:
        return pd.DataFrame({"u": [], "v": []})
    nids, sets, n = frames.nid.tolist(), frames.sh.tolist(), len(frames)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner, values = np.repeat(np.arange(n), sizes), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a shingle of one document adds to no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    width, start = 4096, 0
    while start < len(column):
        first = column[start]
        stop = np.searchsorted(column, first + width)
        dense = np.zeros((n, width), np.float32)
        dense[owner[start:stop], column[start:stop] - first] = 1
        common += dense @ dense.T
        start = stop
    union = sizes[:, None] + sizes[None, :] - common
    linked = 100 * common >= percent * union
    seen, u, v = np.zeros(n, bool), [], []
    for i in range(n):  # breadth first: each found document once
        if not seen[i]:
            seen[i], queue = True, [i]
            while queue:
                new = np.flatnonzero(linked[queue.pop()] & ~seen)
                seen[new] = True
                queue += new.tolist()
                u += [nids[i]] * len(new)
                v += [nids[k] for k in new]
    return pd.DataFrame({"u": u, "v": v})


def linked(docs: DataFrame, percent: int, n: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, at, n_shingles, nid) and nodes (nid, copies, component, component_id): rows with equal sets are one node.

    component is a node of the group and the same for all of it; component_id the smallest doc_id of the group's rows.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sets = shingled(docs, "doc_id", "text", n).select("doc_id", "at", "nid", F.size("sh").cast("long").alias("n_shingles"), "sh")
    signed = cut(sets.mapInArrow(minhash, "doc_id long, at long, nid binary, n_shingles long, sig array<long>, bands array<long>"), "minhash")
    nodes = signed.where("nid is not null").groupBy("nid").agg(F.min("doc_id").alias("first_id"), F.min("at").alias("at"), F.count("*").alias("copies"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    nodes = cut(nodes, "nodes")

    # Buckets of two or more; each member with its bucket's smallest member and size.
    banded = nodes.select("nid", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("nid").alias("pivot"), F.count("nid").alias("members")).where("members > 1")
    members = cut(banded.join(buckets, "band").where("members > 1"), "members")

    # Small buckets: pairs, thinned by the estimate.
    few = members.where(F.col("members") <= SMALL)
    pairs = few.select("band", F.col("nid").alias("u")).join(few.select("band", F.col("nid").alias("v")), "band").where("u < v").select("u", "v").distinct()
    sig_u, sig_v = nodes.select(F.col("nid").alias("u"), F.col("sig").alias("sig_u")), nodes.select(F.col("nid").alias("v"), F.col("sig").alias("sig_v"))
    least = percent / 100
    p = least + (1 - least) * 2.0**-BITS
    margin = SIGMAS * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)
    near = cut(pairs.join(sig_u, "u").join(sig_v, "v").where(estimate(F.col("sig_u"), F.col("sig_v")) >= least - margin).select("u", "v"), "pairs")
    # The members of a pivot are dealt to slices of about BLOCK; a pivot has as many as the largest of its buckets needs.
    slices = F.ceil(F.max("members") / BLOCK).cast("int")
    groups = members.where(F.col("members") > SMALL).groupBy("pivot", "nid").agg(slices.alias("slices"))
    groups = cut(groups.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "nid"), F.col("slices")).cast("int")), "groups")

    # Whole sets of the nodes that are in question, made again from one of each node's texts.
    asked = near.select(F.col("u").alias("nid")).union(near.select("v")).union(groups.select("nid")).distinct()
    asked = asked.join(nodes.select("nid", "at"), "nid").select("at").distinct()
    again = docs.join(asked.withColumnRenamed("at", "_at"), place("doc_id", "text") == F.col("_at"), "left_semi")
    # No filter or join on the made columns before the write: Spark would push it below them and make them again for each word.
    whole = cut(shingled(again, "doc_id", "text", n).dropDuplicates(["nid"]).select("nid", "sh"), "sets")

    set_u, set_v = whole.select(F.col("nid").alias("u"), F.col("sh").alias("sh_u")), whole.select(F.col("nid").alias("v"), F.col("sh").alias("sh_v"))
    confirmed = lambda df: df.withColumn("common", F.size(F.array_intersect("sh_u", "sh_v"))).where(100 * F.col("common") >= percent * (F.size("sh_u") + F.size("sh_v") - F.col("common"))).select("u", "v")
    links = confirmed(near.join(set_u, "u").join(set_v, "v"))

    # Large buckets: each member against the pivot first; those that it does not link to, against all, block by block.
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    most = cut(groups.groupBy("pivot").agg(F.max("slices").alias("slices"), F.ceil(F.count("nid") / BLOCK).cast("int").alias("all_blocks")), "pivots")
    spokes = groups.where("pivot <> nid").select(F.col("nid").alias("u"), F.col("pivot").alias("v"), "slice").join(set_u, "u")
    hubs = most.select(F.col("pivot").alias("v"), "slices").join(set_v, "v").select("v", "sh_v", each("slices").alias("slice"))
    star = cut(confirmed(spokes.join(hubs, ["v", "slice"])), "stars")
    rest = cut(groups.where("pivot <> nid").join(star.select(F.col("v").alias("pivot"), F.col("u").alias("nid")), ["pivot", "nid"], "left_anti"), "rest")
    left = rest.groupBy("pivot").agg(F.ceil(F.count("nid") / BLOCK).cast("int").alias("rest_blocks"))
    dealt = most.join(left, "pivot").select("pivot", "all_blocks", "rest_blocks", each("slices").alias("slice"))
    block = lambda c: F.pmod(F.xxhash64(F.lit(c), "nid"), F.col(c)).cast("int")
    one = rest.join(dealt, ["pivot", "slice"]).select("pivot", "nid", block("rest_blocks").alias("low"), each("all_blocks").alias("high")).join(whole, "nid")
    other = groups.join(dealt, ["pivot", "slice"]).select(F.col("pivot").alias("o_pivot"), "nid", each("rest_blocks").alias("o_low"), block("all_blocks").alias("o_high")).join(whole, "nid").withColumnsRenamed({"nid": "o_nid", "sh": "o_sh"})
    blocks = one.groupBy("pivot", "low", "high").cogroup(other.groupBy("o_pivot", "o_low", "o_high")).applyInPandas(lambda x, y: block_links(x, y, percent), "u binary, v binary")

    labels = components(links.union(star).union(blocks), "near")
    nodes = cut(nodes.select("nid", "first_id", "copies").join(labels, nodes.nid == labels.node, "left").withColumn("component", F.coalesce("component", "nid")).drop("node"), "labelled")
    smallest = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("weight")).where("weight > 1")
    known = looked_up(nodes.select("nid", "first_id", "copies", "component"), smallest, "component", "weight")
    return signed.select("doc_id", "at", "n_shingles", "nid"), known.select("nid", "copies", "component", F.coalesce("component_id", "first_id").alias("component_id"))


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows with the columns of table, which has one row per key and tells in `weight` how many of the rows have it; null where it has none.

    Keys of more than one in HOT of the rows are HOT at most: they are broadcast, so that no key is one task's work.
    """
    table = cut(table, "looked-up")
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot, others = F.col(weight) * HOT > total, [c for c in table.columns if c != weight]
    hot, usual = F.broadcast(table.where(is_hot).select(*others)), table.where(~is_hot).select(*others)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(usual, key, "left"))


def placed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with their node's component and component_id; null without a node."""
    return looked_up(rows, nodes.select("nid", "copies", "component", "component_id"), "nid", "copies")


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (doc_id = component_id).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Documents with
    equal sets are one node from the start, so copies cost one row each. Nodes that share a band are candidates:
    those of a small bucket as pairs, which the b-bit estimate thins out before whole sets are compared; those of
    a large bucket under its smallest member, with which each is compared first, and those that it does not link to
    with all of them, block by block. Every link that is used has been confirmed on whole sets. Null and wordless
    texts have no shingles and link with nothing; repeated rows share a node; a null doc_id is never the smallest
    unless its group has no other (then component_id is null) and is never kept. Extra columns are not read.

    Shuffled: one row of 40 bytes per node and band, signatures and sets of candidates only. A bucket of any size
    is split into blocks, each pair of blocks a group of at most 2 * BLOCK documents.
    """
    out = placed(*linked(docs, percent, n, doc_id, text))
    component = F.when(F.col("nid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """One document of each group of near-duplicates of docs, with all its columns: the rows with the group's smallest doc_id.

    Of rows that share that doc_id all stay. A group whose rows have no doc_id keeps one of them. Texts without words are
    in no group: they stay.
    """
    rows, nodes = linked(docs, percent, n, "doc_id", "text")
    known = cut(placed(rows, nodes), "components")
    kept = known.where("doc_id = component_id or doc_id is not null and nid is null").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(kept, docs.doc_id == kept.kept_id, "left_semi")
    nameless = known.where("doc_id is null and component_id is null and nid is not null").groupBy("component").agg(F.min("at").alias("kept_at")).select("kept_at")
    others = docs.where("doc_id is null").withColumn("_at", place("doc_id", "text")).join(nameless, F.col("_at") == F.col("kept_at"))
    one = others.groupBy("_at").agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.xxhash64(*[docs[c] for c in docs.columns])).alias("_row")).select("_row.*")
    wordless = docs.where(F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return named.unionByName(one).unionByName(wordless)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; three-word shingles, similarity of 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
