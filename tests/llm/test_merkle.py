"""Merkle manifest against a plain tree in one place."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandwork.llm import merkle as M

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spelled(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def found_now(row):
    """The row as it is found: where 3 divides the crc32 of its id, A-Z of its text are lower-cased."""
    hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"]
    return {**row, "text": "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"])} if hit else row


def tree(nodes, fanout):
    """Root, and for each leaf the hashes to its left and right at each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            a = at[k] - at[k] % fanout
            path.append(("".join(nodes[a : at[k]]), "".join(nodes[at[k] + 1 : a + fanout])))
            at[k] //= fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(docs, fanout=8):
    groups = defaultdict(list)
    for d in docs:
        leaf, seen = (sha("".join(spelled(r[f]) for f in M.FIELDS)) for r in (d, found_now(d)))
        groups[d["lang"]].append((d["doc_id"], leaf, seen))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    parts = {g: tree([x[1] for x in groups[g]], fanout) for g in order}
    root, upper = tree([parts[g][0] for g in order], fanout)
    out = []
    for g, above in zip(order, upper):
        for (doc_id, leaf, seen), path in zip(groups[g], parts[g][1]):
            node = seen
            for left, right in path + above:
                node = sha(left + node + right)
            out.append((doc_id, leaf, parts[g][0], root, sha("".join(a + b for a, b in path + above)), node, node == root))
    return out


def same(df, expected):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows(df)), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("where", ["sf", "odd_dir"])
def test_whole_query(spark, where, request):
    path = request.getfixturevalue(where)
    same(M.op12_merkle_manifest(spark, path), brute(rows(spark.read.parquet(f"{path}/documents.parquet").select(*M.FIELDS))))


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 1), (2, 2)])
def test_many_rounds(spark, sf, fanout, levels):
    """Small blocks make the exchange go over many rounds, with last subtrees of all sizes, and a dozen groups."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 11 <> 3 or doc_id < 20").withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("é"), (F.col("doc_id") % 11).cast("string"))))
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, M.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    same(M.manifest(docs, seen=[F.col(f) if f != "text" else text for f in M.FIELDS], fanout=fanout, levels=levels), brute(rows(docs.select(*M.FIELDS)), fanout))


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_sizes(spark, n):
    """A lone leaf is its group's subroot and the root; its proof is the hash of nothing."""
    docs = spark.createDataFrame([(i, "s", "en", 3, f"Text {i}") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string")
    same(M.manifest(docs).withColumn("x", F.lit(1)), [(*r[:5], r[3], True) for r in brute(rows(docs))])
    if n == 1:
        r = rows(M.manifest(docs))[0]
        assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("")


def test_repeated_rows(spark):
    """Rows alike in all fields, and null ids, each have a place and a proof."""
    docs = spark.createDataFrame([(None, "s", None, 1, "A"), (None, "s", None, 1, "A"), (None, "s", "", 1, "b")] + [(5, None, "en", None, None)] * 20, "doc_id long, source string, lang string, n_chars long, text string")
    same(M.manifest(docs.withColumns({"pos": F.lit("x"), "block": F.lit(1), "leaf": F.lit("y")}), fanout=2, levels=1), [(*r[:5], r[3], True) for r in brute(rows(docs), 2)])


def test_empty(spark, empty_dir):
    assert M.op12_merkle_manifest(spark, empty_dir).count() == 0


def test_exchange_sends_nothing_down(spark):
    """Each round meets at most `fanout` nodes at a place, and rows of a round are under twice the nodes."""
    n = 8**3 + 3
    nodes = spark.range(n).select(F.lit("t").alias("tree"), F.col("id").alias("i"), F.lit(n).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    got = {r["i"]: r for r in rows(M.butterfly(nodes))}
    root, paths = tree([sha(str(i)) for i in range(n)], 8)
    assert len(got) == n and {r["root"] for r in got.values()} == {root}
    assert all([(x["left"], x["right"]) for x in got[i]["above"]] == paths[i] for i in range(n))
