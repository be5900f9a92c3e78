"""Language ID: held-out accuracy, and the vectors against a slow definition."""

import zlib

import numpy as np
import pytest
from conftest import rows

from strandwork.llm import language_id as L


def test_held_out_accuracy(spark, sf):
    found = rows(L.op5_language_id(spark, sf))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(found) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    told = [(r["lang_pred"], docs[r["doc_id"]].lang) for r in found if r["held_out"] and docs[r["doc_id"]].lang and docs[r["doc_id"]].n_chars > 100]
    assert np.mean([a == b for a, b in told]) > 0.95


@pytest.mark.parametrize("text", ["abc", "Ab, c\n\ndéf", "x", "日本語 text"])
def test_profile(text):
    a, b, c = L.letter_vectors()
    s = L.slots_of(text)
    total = sum(a[x].astype(int) * b[y] * c[z] for x, y, z in zip(s, s[1:], s[2:]))
    assert np.allclose(L.profile(text, (a, b, c)), total / np.linalg.norm(total), atol=1e-5)


def test_odd(spark, odd_dir, empty_dir):
    found = rows(L.op5_language_id(spark, odd_dir))
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in found)
    assert sum(r["lang_pred"] == "und" for r in found) == sum(not any(c.isalpha() for c in d.text or "") for d in docs)
    assert L.op5_language_id(spark, empty_dir).count() == 0


def test_whole_query_by_plain_python(spark, sf, odd_dir):
    """Prototypes and predictions of the whole table, by sums over trigrams one at a time."""
    a, b, c = L.letter_vectors()

    def slow(text):
        if not text or not any(ch.isalpha() for ch in text.lower()):
            return None
        s, total, bound = [int(x) for x in L.slots_of(text)], np.zeros(L.DIMENSIONS), {}
        for t in zip(s, s[1:], s[2:]):
            if t not in bound:
                bound[t] = a[t[0]].astype(float) * b[t[1]] * c[t[2]]
            total += bound[t]
        return total / np.linalg.norm(total)

    for path in (sf, odd_dir):
        docs = spark.read.parquet(f"{path}/documents.parquet").collect()
        sums, profiles = {}, [slow(d.text) for d in docs]
        for d, p in zip(docs, profiles):
            out = d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 3 == 1
            if p is not None and d.lang is not None and not out:
                sums[d.lang] = sums.get(d.lang, 0) + p
        names = sorted(sums)
        protos = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
        expected = []
        for d, p in zip(docs, profiles):
            cosine = None if p is None else protos @ p
            expected.append((repr(d.doc_id), "und" if p is None else names[int(np.argmax(cosine))], 0.0 if p is None else min(1.0, max(0.0, float(cosine.max())))))
        found = sorted((repr(r["doc_id"]), r["lang_pred"], r["score"]) for r in rows(L.op5_language_id(spark, path)))
        for x, y in zip(found, sorted(expected)):
            assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-4


def test_very_many_languages(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', cast(id as string), ' abc') as text", "concat('l', cast(id as string)) as lang")
    assert len(L.learn(docs)) == 3000
