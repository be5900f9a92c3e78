"""MinHash near-dedup against all pairs in plain Python."""

import random
import re
from collections import defaultdict

import pytest
from conftest import rows, same

from strandwork.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs, percent=85, n=3):
    """docs: (doc_id, text). All pairs that share a shingle, counted exactly."""
    sets = [shingles(t, n) for _, t in docs]
    distinct = list({s for s in sets if s})
    at, holders, common = {s: i for i, s in enumerate(distinct)}, defaultdict(list), defaultdict(int)
    for i, s in enumerate(distinct):
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        for x in range(len(ids)):
            for y in ids[x + 1 :]:
                common[ids[x], y] += 1
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (x, y), c in common.items():
        if 100 * c >= percent * (len(distinct[x]) + len(distinct[y]) - c):
            root[find(x)] = find(y)
    smallest = {}
    for (i, _), s in zip(docs, sets):
        if s and i is not None:
            r = find(at[s])
            smallest[r] = min(smallest.get(r, i), i)
    out = []
    for (i, _), s in zip(docs, sets):
        c = smallest.get(find(at[s])) if s else i
        out.append({"doc_id": i, "n_shingles": len(s), "component_id": c, "kept": i is not None and i == c})
    return out


COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("where", ["sf", "odd_dir"])
def test_whole_table(spark, where, request):
    path = request.getfixturevalue(where)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    same(rows(near_dedup.op4_near_dedup(spark, path)), brute(docs), COLUMNS)


def test_large_groups(spark, monkeypatch):
    """A group of near copies over several blocks whose members link in chains, exact copies, and pairs just over and under the limit."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
        docs.append((1000 - i, " ".join(t)))
    docs += [(2000 + i, " ".join(base[:60])) for i in range(40)]
    docs += [(3000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(30))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    same(rows(near_dedup.near_duplicates(frame)), brute(docs), COLUMNS)


def test_keep_first(spark, odd_docs):
    kept = near_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()


def test_empty(spark, empty_dir):
    assert near_dedup.op4_near_dedup(spark, empty_dir).count() == 0


def test_null_ids(spark):
    """Rows without an id link like others, and of a group that has no id one row stays."""
    base = [f"w{i}" for i in range(60)]
    other, far = " ".join([*base[:59], "x"]), " ".join(f"z{i}" for i in range(40))
    docs = [(None, " ".join(base)), (5, other), (None, far), (None, far), (None, far + " more"), (None, ""), (None, None), (7, ""), (8, "one two"), (8, "one two"), (9, "one two")]
    frame = spark.createDataFrame([(*d, k) for k, d in enumerate(docs)], "doc_id long, text string, k int")
    same(rows(near_dedup.near_duplicates(frame)), brute(docs), COLUMNS)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows(near_dedup.keep_first(frame)))
    assert kept[:4] == [(False, 5, other), (False, 7, ""), (False, 8, "one two"), (False, 8, "one two")]
    assert kept[4:6] == [(True, 0, ""), (True, 0, "")] and len(kept) == 7 and kept[6][2] in (far, far + " more")
