"""Source divergence audit against exact whole numbers in plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandwork.llm import source_divergence as S

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, min_docs=10, top=10):
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for d in docs:
        lang, source = d["lang"] or "", d["source"] or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(d["text"] or "")]
        groups[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        own = {s: groups[g, s] for g, s in groups if g == lang}

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 2) // total for t in kept}

        p, q = {s: shares(n) for s, n in own.items()}, shares(sum(own.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, n in own.items():
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if n[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return out


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows(df))


@pytest.mark.parametrize("where", ["sf", "odd_dir"])
def test_whole_query(spark, where, request):
    path = request.getfixturevalue(where)
    assert found(S.op11_source_divergence(spark, path)) == sorted(brute(rows(spark.read.parquet(f"{path}/documents.parquet"))))


def test_vocabularies_in_parts(spark, sf):
    """More kept terms than one vocabulary may hold give the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source")
    assert found(S.divergence(docs, max_terms=400)) == found(S.divergence(docs))


@pytest.mark.parametrize("own", [0, 1])
def test_languages_side_by_side(spark, sf, own):
    """Languages that share a vocabulary give the same rows as those with one of their own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source")
    assert found(S.divergence(docs, own=own)) == found(S.divergence(docs))


def test_only_ascii_is_lowered(spark):
    """Every code point beyond ASCII stays as it is, in texts with A-Z and without, by either way of lowering."""
    points = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 512]) for i in range(0, len(points), 512)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1 - i, p) for i, p in enumerate(points) if p.lower() != p or p.upper() != p], "i long, text string")
    assert df.where((F.array_join(S.terms(F.concat(F.lit("Aß"), "text", F.lit("Z"))), "|") != F.concat(F.lit("aß"), "text", F.lit("z")))).count() == 0


def test_odd_texts(spark, odd_docs):
    docs = odd_docs.unionByName(odd_docs).select("text", "lang", "source", "n_words")
    assert found(S.divergence(docs, min_docs=2, top=3)) == sorted(brute(rows(docs), 2, 3))


def test_marks_in_names(spark):
    """Languages that hold the mark, groups without terms, ties by bytes."""
    texts = [("a b é z", "x\0", "s"), ("a a b 𝒳", "x\0", "t"), ("a\0b ｚ 𝒳", "x\0", "u\0"), ("", "x\0", "none"), (None, "x", None), ("a", "x", "")]
    docs = spark.createDataFrame(texts, "text string, lang string, source string")
    assert found(S.divergence(docs, min_docs=1)) == sorted(brute(rows(docs), 1))


def test_empty(spark, empty_dir):
    assert S.op11_source_divergence(spark, empty_dir).count() == 0


def test_shares_of_large_counts(spark):
    big = 10**17
    got = spark.sql(f"SELECT {big} AS n, {3 * big} AS whole, 12345L AS v").select(S.share("n", "whole", "v").alias("p")).first().p
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 2 * 12345)
