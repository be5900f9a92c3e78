"""Licence scans: the base by plain Python, planted copies of every template, near misses, very long and repetitive texts."""

import random
import re
import time

import pytest
from conftest import rows, same

from strandwork.llm import licence_scans as L
from strandwork.llm.licence_texts import TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc_id, text):
    w = words(text)
    hits = [(i, label) for phrase, label in L.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return {"doc_id": doc_id, "n_words": len(w), "n_base": len(hits), "first_word": min((i for i, _ in hits), default=None), "last_word": max((i for i, _ in hits), default=None), "base_labels": ",".join(sorted({x for _, x in hits}))}


@pytest.mark.parametrize("where", ["sf", "odd_dir"])
def test_base(spark, where, request):
    path = request.getfixturevalue(where)
    found = rows(L.op13_licence_scans(spark, path))
    docs = rows(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"))
    same(found, [brute(d["doc_id"], d["text"]) for d in docs], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"])
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in found)


def test_labels_of_the_whole_table(spark, sf):
    """Labels beside the base's are those of documents that hold a notice's key phrases: by plain search over all documents."""
    found = {r["doc_id"]: r["labels"] for r in rows(L.op13_licence_scans(spark, sf))}
    for d in rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        spread = f" {' '.join(words(d['text']))} "
        expected = set(brute(0, d["text"])["base_labels"].split(",")) - {""}
        expected |= {label for label, keys, text in TEMPLATES if len(words(text)) < 9 and all(f" {k} " in spread for k in keys.split("|")) and f" {' '.join(words(text))} " in spread}
        assert found[d["doc_id"]] == ",".join(sorted(expected))


FLAT = {w: 1.0 for label, keys, text in TEMPLATES for w in L.words_of(text) + L.words_of(keys)}


@pytest.mark.parametrize("t", range(len(TEMPLATES)))
def test_every_template(t):
    """A copy in the middle of other words, with other marks and a name put in, is found where it stands; one without a key phrase is not."""
    label, keys, text = TEMPLATES[t]
    rng, index = random.Random(t), L.Index(FLAT)
    noise = lambda n: " ".join(rng.choice(["mit", "the", "software", "of", "haus", "was", "été"]) for _ in range(n))
    copy = re.sub(r"\s+", "\n * ", text.upper()).replace("COPYRIGHT HOLDER ", "Ünternehmen X Y ")
    got = L.judged(f"{noise(3000)} {copy} {noise(2000)}", index)
    assert label in got[5].split(",")
    place = next(p for p in got[7] if p["label"] == label)
    assert 3000 <= place["start"] and place["stop"] <= 3000 + len(L.words_of(copy)) + L.DRIFT and place["score"] >= L.LEAST
    broken = text
    for w in L.words_of(keys.split("|")[0])[-1:]:
        broken = re.sub(rf"(?i)\b{w.decode()}\b", "foo", broken)
    assert label not in L.judged(f"{noise(300)} {broken} {noise(200)}", index)[5].split(",")


def test_within():
    index = L.Index(FLAT)
    two, three = (next(t[2] for t in TEMPLATES if t[0] == x) for x in ("bsd-2", "bsd-3"))
    assert L.judged(two, index)[5] == "bsd-2" and L.judged(three, index)[5] == "bsd-3"
    assert L.judged(two + " x" * 500 + three, index)[5] == "bsd-2,bsd-3"  # a place of its own


def test_scattered_words_are_no_licence():
    words = sorted(FLAT)
    rng = random.Random(5)
    text = b" ".join(rng.choice(words) for _ in range(20_000)).decode()
    assert L.judged(text, L.Index(FLAT))[5] == ""


def test_long_and_repetitive_texts():
    """Time in proportion to the text: a megabyte of one word, of a phrase, of most of a licence."""
    mit = TEMPLATES[0][2].replace("dealings", "feelings").replace("persons", "people")
    for text in ("license " * 130_000, "under the mit license " * 50_000, "licensed under the gnu general public " * 27_000, mit * 1000, "permission is hereby granted free of charge deal in the software without restriction the software is provided as is " * 9000):
        start = time.time()
        L.judged(text, L.Index(FLAT))
        assert time.time() - start < 10


def test_carried_and_clashing_columns(spark, odd_docs, empty_dir):
    found = L.scan(odd_docs, ["doc_id", "text", "row"])
    assert found.columns[:3] == ["doc_id", "text", "row"] and found.count() == odd_docs.count()
    with pytest.raises(ValueError):
        L.scan(odd_docs, ["n_words"])
    assert L.op13_licence_scans(spark, empty_dir).count() == 0


def test_rarities_count_all_documents(spark):
    docs = spark.createDataFrame([("mit Mit license",), ("mit",), (None,), ("",)], "text string").repartition(3)
    idf = L.rarities(docs)
    assert idf[b"license"] > idf[b"mit"] and idf[b"license"] == pytest.approx(1 + __import__("math").log(5 / 2))
