"""Licence scans: a positional index of the licence texts' rare words; postings that agree on the relative position are verified by key phrases."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import TEMPLATES, WITHIN

#: Phrases of the base and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Rarest words of a template that are looked up in a file; those of them that have to agree on a relative position (all, if there are fewer);
#: words by which a copy may shift (names put in, numbering); share of a template's weight that a copy must hold.
RAREST, AGREE, DRIFT, LEAST = 8, 2, 12, 0.8
#: What each byte of a text becomes: A-Z lower-cased, digits, a-z and all bytes beyond ASCII as they are, spaces for the others.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,stop:long,score:double>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, as UTF-8: runs of digits, letters and all that is beyond ASCII, with A-Z lower-cased and nothing else."""
    return text.encode().translate(BYTES).split() if text else []


class Index:
    """Postings of the templates' words: word to (template, position); a word's weight is its rarity over the corpus."""

    def __init__(self, idf: dict[bytes, float], templates: Sequence[tuple[str, str, str]] = TEMPLATES):
        self.idf, self.labels, self.words, self.keys = idf, [t[0] for t in templates], [words_of(t[2]) for t in templates], [[words_of(k) for k in t[1].split("|")] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for i, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, i))

    def places(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, share of the template's weight) of the best copy of each label in a file."""
        held = self.postings.keys() & set(words)
        if len(held) < AGREE:
            return []
        # The file's licence words from the rarest on: each template is looked up by the first RAREST of them that it has.
        wanted: dict[int, list[bytes]] = {}
        for w in sorted(held, key=lambda w: (-self.idf[w], w)):
            for t in {t for t, _ in self.postings[w]}:
                if len(wanted.setdefault(t, [])) < RAREST:
                    wanted[t].append(w)
        wanted = {t: ws for t, ws in wanted.items() if len(ws) >= min(AGREE, len(set(self.words[t]))) and all(w in held for k in self.keys[t] for w in k)}
        if not wanted:
            return []
        looked_up = {w for ws in wanted.values() for w in ws} | {w for t in wanted for k in self.keys[t] for w in k}
        at: dict[bytes, list[int]] = {w: [] for w in looked_up}
        for i, w in enumerate(words):
            if w in looked_up:
                at[w].append(i)
        found: dict[str, tuple[str, int, int, float]] = {}
        for t, ws in wanted.items():
            best = self.best(t, ws, words, at)
            if best and (self.labels[t] not in found or best[3] > found[self.labels[t]][3]):
                found[self.labels[t]] = best
        for whole, part in WITHIN.items():
            if whole in found and part in found and found[part][1] < found[whole][2] and found[whole][1] < found[part][2]:
                del found[part]
        return sorted(found.values())

    def best(self, t: int, ws: list[bytes], words: list[bytes], at: dict[bytes, list[int]]) -> tuple[str, int, int, float] | None:
        """The best copy of one template: postings that agree on where it would begin, then its key phrases there, then its weight."""
        phrases = [self.starts(k, words, at) for k in self.keys[t]]
        if not all(phrases):
            return None
        chosen, size = set(ws), len(self.words[t])
        begins = sorted({(i - j, w) for w in chosen for p, j in self.postings[w] if p == t for i in at[w]})
        need, low, inside, tried, best = min(AGREE, len(chosen)), 0, Counter(), None, None
        for high, (begin, w) in enumerate(begins):
            inside[w] += 1
            while begin - begins[low][0] > DRIFT:
                inside[begins[low][1]] -= 1
                if not inside[begins[low][1]]:
                    del inside[begins[low][1]]
                low += 1
            if len(inside) < need or begins[low][0] == tried:
                continue
            tried = begins[low][0]
            first, last = max(0, tried - DRIFT), tried + size + 2 * DRIFT
            ends = [bisect_left(p, first) for p in phrases]
            if any(e == len(p) or p[e] + len(k) > last for e, p, k in zip(ends, phrases, self.keys[t])):
                continue
            there = Counter(words[first:last])
            want = Counter(self.words[t])
            weight = sum(self.idf[x] * n for x, n in want.items())
            share = sum(self.idf[x] * min(n, there[x]) for x, n in want.items()) / weight if weight else 1.0
            if share >= LEAST and (best is None or share > best[3]):
                best = (self.labels[t], min(p[e] for e, p in zip(ends, phrases)), min(len(words), max(p[e] + len(k) for e, p, k in zip(ends, phrases, self.keys[t]))), min(1.0, share))
                if share >= 1.0:
                    break
        return best

    @staticmethod
    def starts(phrase: list[bytes], words: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
        """Where a phrase's words stand consecutively: looked up from the one of them that the file has least often."""
        k = min(range(len(phrase)), key=lambda i: len(at[phrase[i]]))
        return [i - k for i in at[phrase[k]] if i >= k and words[i - k : i - k + len(phrase)] == phrase]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of all places of the base's phrases."""
    seen, out = set(words), []
    for phrase, label in BASE:
        parts = words_of(phrase)
        if seen.issuperset(parts):
            i, last = -1, parts[-1]
            while True:  # by the last word, which is rarer than the first
                try:
                    i = words.index(last, i + 1)
                except ValueError:
                    break
                if i + 1 >= len(parts) and words[i + 1 - len(parts) : i + 1] == parts:
                    out.append((i + 1 - len(parts), label))
    return out


def judged(text: str | None, index: Index) -> tuple:
    """The columns of SCHEMA for one text."""
    words = words_of(text)
    base, more = base_places(words), index.places(words)
    starts, labels = [s for s, _ in base], {x for _, x in base}
    score = 1.0 if base else max((round(m[3], 6) for m in more), default=0.0)
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {m[0] for m in more})), score, [{"label": a, "start": b, "stop": c, "score": round(d, 6)} for a, b, c, d in more])


def rarities(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency of each of the templates' words, counted over all documents; a null text counts as a document.

    Each task sends one number for each of those words at most, so the driver gets as many as the templates have.
    """
    vocabulary = {w for _, _, t in templates for w in words_of(t)} | {w for _, keys, _ in templates for w in words_of(keys.replace("|", " "))}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            n[b""] += batch.num_rows
            for t in batch.column(0).to_pylist():
                n.update(vocabulary & set(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    n = {bytes(r.word): r.n for r in docs.select(F.col(text).alias("text")).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: math.log((n.get(b"", 0) + 1) / (n.get(w, 0) + 1)) + 1.0 for w in vocabulary}


def scan(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text", templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """The carried columns of docs, then n_words, n_base, first_word, last_word, base_labels, labels, score and places (label, start, stop, score).

    For each file, each template is looked up by the RAREST of its words that the file has, rarest over the whole corpus
    first. Their postings tell where the template would begin; where AGREE different words agree within DRIFT, the key phrases
    must stand and LEAST of the template's weight must be there. That finds every whole copy, however long the file
    is; places hold the best copy of each label. The score is 1 with a place of the base, else the largest share.

    Null and empty texts have no words, no labels and score 0; equal rows are judged alike; null ids are as good as any; an
    empty table gives no rows. Extra columns are not read, and carried ones are renamed inside, so none clash (one with
    the name of a result raises). Two passes over the texts (counts, then the scan), no shuffle but the counts. Time is in proportion to a
    text's words.
    """
    clash = set(carry) & {c.strip().split()[0] for c in SCHEMA.split("array<")[0].split(",")}
    if clash:
        raise ValueError(f"carried columns have names of results: {sorted(clash)}")
    idf = rarities(docs, text, templates)
    fields = [docs.schema[c] for c in carry]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf, templates)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])))
        for batch in batches:
            rows = [judged(t, index) for t in batch.column(batch.num_columns - 1).to_pylist()]
            found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*[f"c{i}" for i in range(len(fields))], *[x.split()[0] for x in SCHEMA.split(", ")]])

    asked = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("_text"))
    out = asked.mapInArrow(scanned, ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + [SCHEMA]))
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})


def op13_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("places")
