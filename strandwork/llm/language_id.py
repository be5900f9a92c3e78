"""Language ID by hyperdimensional profiles: letter vectors bound into trigram vectors, bundled, compared by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dimensions; slots that letters are dealt to (0: anything else); seed of the letter vectors.
DIMENSIONS, SLOTS, SEED = 512, 1024, 77
#: About how many labelled rows the prototypes are learned from: there are no more languages than that.
MAX_TRAINING = 40_000


def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random vector of +1 and -1 per slot, and the same permuted once and twice: place in the trigram is the permutation."""
    rng = np.random.default_rng(SEED)
    first, order = rng.choice(np.array([-1, 1], np.int8), (SLOTS, DIMENSIONS)), rng.permutation(DIMENSIONS)
    return first, first[:, order], first[:, order][:, order]


def slots_of(text: str) -> np.ndarray:
    """Slot of each character of the lower-cased text; runs of other characters than letters are one 0, and each end has one."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (code >= 97) & (code <= 122)
    beyond = np.flatnonzero(code >= 0xAA)
    if len(beyond):
        kinds, at = np.unique(code[beyond], return_inverse=True)
        letter[beyond] = np.array([chr(c).isalpha() for c in kinds])[at]
    slot = np.where(letter, np.where(code < 128, code - np.uint32(96), np.uint32(27) + code % np.uint32(SLOTS - 27)), np.uint32(0)).astype(np.int64)
    keep = np.ones(len(slot), bool)
    keep[1:] = (slot[1:] > 0) | (slot[:-1] > 0)
    return np.concatenate(([0], slot[keep], [0]))


def profile(text: str | None, vectors: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray | None:
    """The bundle of a whole text's trigram vectors, scaled to length 1; None without a letter."""
    if not text:
        return None
    s = slots_of(text)
    if not s.any():
        return None
    kinds, count = np.unique((s[:-2] * SLOTS + s[1:-1]) * SLOTS + s[2:], return_counts=True)
    bound = vectors[0][kinds // (SLOTS * SLOTS)] * vectors[1][kinds // SLOTS % SLOTS] * vectors[2][kinds % SLOTS]
    total = count.astype(np.float32) @ bound.astype(np.float32)
    length = float(np.sqrt(total.astype(np.float64) @ total))
    return total / length if length else total


def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language and task: the sum of the profiles of its texts."""
    vectors, sums = letter_vectors(), {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p = profile(text, vectors)
            if p is not None:
                sums[lang] = sums.get(lang, 0) + p.astype(np.float64)
    if sums:
        # Whole numbers of 2^-20, so that the sum does not depend on the order of tasks.
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([np.rint(v * 2**20).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])


def learn(labelled: DataFrame, max_training: int = MAX_TRAINING) -> dict[str, np.ndarray]:
    """Prototype (length 1) of each language of labelled (text, lang; no null lang), from about max_training of its rows.

    The rows are those whose text hashes into the share max_training / rows; all of them if there are fewer. Each
    task sends one bundle per language; those are summed by language and dimension, and only the prototypes reach the
    driver: 4 KB for each language of the chosen rows.
    """
    rows = max(labelled.count(), 1)
    share = min(1.0, max_training / rows)
    chosen = labelled if share == 1.0 else labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sums = chosen.select("text", "lang").mapInArrow(bundles, "lang string, bundle array<long>")
    parts = sums.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found = parts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("bundle")).collect()
    out = {}
    for r in sorted(found, key=lambda r: r.lang):
        v = np.array([x.v for x in r.bundle], np.float64)
        length = np.linalg.norm(v)
        if length:
            out[r.lang] = v / length
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs: the language of the nearest prototype and its cosine (0 at least).

    `und` and 0 for null texts, texts without a letter, and where nothing was learned. Of equally near languages
    the first by code point wins. The whole text counts; extra columns are not read; repeated rows are predicted alike.
    """
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float64).reshape(len(prototypes), DIMENSIONS)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = letter_vectors()
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(2).to_pylist():
                p = profile(t, vectors) if names else None
                if p is None:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    cosine = matrix @ p.astype(np.float64)
                    best = int(np.argmax(cosine))
                    langs.append(names[best])
                    scores.append(min(1.0, max(0.0, round(float(cosine[best]), 6))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(nearest, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents that are not held out and have a lang; predicted for all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, learn(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())))
