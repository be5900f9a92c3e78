"""Pieces: exact round trip, and the same segmentation as a plain Viterbi over whole texts."""

import hashlib
import random

import pytest
from conftest import ODD, rows

from strandwork.llm import pieces as P


@pytest.fixture(scope="module")
def v():
    return P.Vocabulary(P.MODEL)


def best_score(v, text):
    """Plain Viterbi over the whole marked text: the best sum of scores."""
    s = P.MARK + text.replace(" ", P.MARK)
    by_piece = {p: i for i, p in enumerate(v.pieces) if i not in v.byte_of and i > 2}
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    longest = max(map(len, by_piece))
    best = [0.0] + [float("-inf")] * len(s)
    for end in range(1, len(s) + 1):
        best[end] = best[end - 1] + v.least - P.UNKNOWN
        for start in range(max(0, end - longest), end):
            i = by_piece.get(s[start:end])
            if i is not None:
                best[end] = max(best[end], best[start] + model.get_score(i))
    return best[-1], model


def test_best_segmentation(spark, sf, v):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text and len(r.text) < 600][:25] + ["  two  spaces ", "naïve 日本 𝒳", "aaaa\t\nb", "x"]
    found = {r["doc_id"]: r["ids"] for r in rows(P.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for k, t in enumerate(texts):
        best, model = best_score(v, t)
        total, i = 0.0, 0
        ids = found[k]
        while i < len(ids):
            if ids[i] in v.byte_of:  # one unknown character's bytes
                lead = v.byte_of[ids[i]]
                i += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                total += v.least - P.UNKNOWN
            else:
                total += model.get_score(ids[i])
                i += 1
        assert abs(total - best) < 1e-6, t
        assert model.decode(ids) == t and v.decode(ids) == t


def test_round_trip(spark, sf, odd_dir):
    for path in (sf, odd_dir):
        docs = spark.read.parquet(f"{path}/documents.parquet").collect()
        found = rows(P.op8_sentencepiece(spark, path))
        key = lambda t: (hashlib.md5((t or "").encode()).hexdigest(), len(t or ""))
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["decoded_md5"], r["decoded_chars"]) for r in found) == sorted((d.doc_id is None, d.doc_id or 0, *key(d.text)) for d in docs)
        assert all(r["n_pieces"] == len(r["ids"]) for r in found)


def test_shared_prefixes(v):
    """Sorted or alone, a word has the same pieces."""
    rng = random.Random(3)
    words = [P.MARK * rng.randrange(3) + "".join(rng.choice("thenaio▁é"[:7]) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + [w for w in ODD if w and P.MARK not in w][:4]
    together = v.encode_words(words)
    assert all(together[w] == v.encode_words([w])[w] for w in words[:200])


def test_empty(spark, empty_dir):
    assert P.op8_sentencepiece(spark, empty_dir).count() == 0


def test_mark_of_the_text_comes_back(spark, v):
    """U+2581 is no space; runs of spaces and spaces at the ends stay."""
    texts = ["a ▁ b", "▁", "▁▁x ▁y", "  a   b  ", " ", "   ", "a ", "é▁ 日本", "", None, "x  ▁  y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(P.encode_and_back(docs))}
    back = {r["doc_id"]: r["text"] for r in rows(P.decode(P.encode(docs)))}
    for k, t in enumerate(texts):
        assert back[k] == (t or "") and v.decode(found[k]["ids"]) == (t or "")
        assert found[k]["decoded_md5"] == hashlib.md5((t or "").encode()).hexdigest() and found[k]["decoded_chars"] == len(t or "")


def test_memory_of_words_is_bounded(spark, monkeypatch, v):
    import pyarrow as pa

    monkeypatch.setattr(P, "REMEMBERED", 3)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [f"w{k} the cat{k % 2} sat"]}) for k in range(6)]
    for k, (_, pieces, back) in enumerate(P.encoded(iter(batches), v)):
        assert back.to_pylist() == [f"w{k} the cat{k % 2} sat"] and v.decode(pieces[0].as_py()) == f"w{k} the cat{k % 2} sat"


def test_slices_of_a_batch(spark, monkeypatch, v):
    """Slices that start inside a batch read their own rows."""
    import pyarrow as pa

    monkeypatch.setattr(P, "IN_WORK", 40)
    texts = [None, "the first", "  é two", "", "日本 ▁", "last " * 30] * 7
    out = []
    for _, pieces, back in P.encoded(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})]), v):
        assert [v.decode(p) for p in pieces.to_pylist()] == back.to_pylist()
        out += back.to_pylist()
    assert out == [t or "" for t in texts]
