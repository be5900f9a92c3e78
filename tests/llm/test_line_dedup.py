"""Line dedup against plain Python: every window of lines that stands earlier is deleted."""

import random
import re

import pytest
from conftest import rows

from strandwork.llm import line_dedup as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, least=D.MIN_WORDS):
    """docs: (doc_id, text) in the order of the rows. Windows of the fewest lines with `least` words, from each start and to each end."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k))
    seen, gone = {}, {k: set() for k in order}
    for k in order:
        lines = [(no, x, len(WORD.findall(x))) for no, x in enumerate((docs[k][1] or "").split("\n")) if WORD.search(x)]
        found = set()
        for step in (1, -1):
            for i in range(len(lines)):
                total, j = 0, i
                while 0 <= j < len(lines) and total < least:
                    total += lines[j][2]
                    j += step
                if total >= least:
                    found.add((i, j - 1) if step == 1 else (j + 1, i))
        for a, b in sorted(found):
            name = tuple(x for _, x, _ in lines[a : b + 1])
            at = (order.index(k), a)
            if name in seen and seen[name] < at:
                gone[k] |= {no for no, *_ in lines[a : b + 1]}
            seen.setdefault(name, at)
    return [(i, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[k]), len(gone[k])) for k, (i, t) in enumerate(docs)]


def check(spark, df, docs, least=D.MIN_WORDS):
    found = [(r["doc_id"], r["text"], r["n_removed"]) for r in rows(D.dedup_lines(df, least).select("_row.doc_id", "text", "n_removed"))]
    assert sorted(found, key=repr) == sorted(brute(docs, least), key=repr)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    check(spark, df, docs)
    assert sum(n for *_, n in brute(docs)) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    """Few different lines, so that runs overlap, nest, repeat within a text and cross each other."""
    rng = random.Random(seed)
    kinds = [" ".join(f"w{k}{i}" for i in range(rng.randrange(1, 7))) for k in range(7)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, row string, gone int").coalesce(1)
    check(spark, df, docs, 9)


def test_odd(spark, odd_docs, odd_dir):
    docs = [(r.doc_id, r.text) for r in odd_docs.coalesce(1).collect()]
    check(spark, odd_docs.coalesce(1), docs)
    kept = D.keep_rest(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() <= len(docs)


def test_empty(spark, empty_dir):
    assert D.op7_line_dedup(spark, empty_dir).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_intervals(spark, partitions):
    """Suffixes are in one interval of depth m if and only if they share their first m lines."""
    rng = random.Random(4)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(25)]
    suffixes = [(s, i, s, bytes([s]), i, t[i : i + 4]) for s, t in enumerate(texts) for i in range(len(t))]
    order = {x: k for k, x in enumerate(sorted({tuple(texts[s][i:]) for s, i, *_ in suffixes}))}
    data = [(s, i, d, r, n, order[tuple(texts[s][i:])], p) for s, i, d, r, n, p in suffixes]
    df = spark.createDataFrame(data, "s long, i int, doc_id long, row binary, no int, rank long, prefix array<long>").repartition(partitions)
    found = rows(D.intervals(df, 4))
    assert len(found) == len(data)
    for m in range(1, 5):
        by_prefix, by_number = {}, {}
        for r in found:
            run = tuple(texts[r["s"]][r["i"] : r["i"] + m])
            if len(run) == m:
                by_prefix.setdefault(run, set()).add(r["intervals"][m - 1])
                by_number.setdefault(r["intervals"][m - 1], set()).add(run)
        assert all(len(x) == 1 for x in by_prefix.values()) and all(len(x) == 1 for x in by_number.values())
