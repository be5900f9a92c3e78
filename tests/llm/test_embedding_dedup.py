"""Embedding near-dedup against all pairs."""

import math

import numpy as np
import pytest
from conftest import rows

from strandwork.llm import embedding_dedup as E


def brute(data, cosine=E.COSINE):
    """data: (vec_id, embedding, label)."""
    ok = [v is not None and len(v) > 0 and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, y in data]
    n = len(data)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    scaled = lambda v: np.array(v, float) / np.abs(np.array(v, float)).max()
    unit = [scaled(v) / np.linalg.norm(scaled(v)) if k else None for (_, v, _), k in zip(data, ok)]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    smallest = {}
    for i, (k, *_) in enumerate(data):
        smallest[find(i)] = min(smallest.get(find(i), k), k)
    return sorted((k, links[i], smallest[find(i)], k == smallest[find(i)]) for i, (k, *_) in enumerate(data))


def got(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(df))


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got(E.op10_embedding_dedup(spark, sf)) == brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_blocks_and_odd(spark, monkeypatch):
    """A hot group over many blocks, copies, scaled copies, and vectors that can't link."""
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(12)
    data = [(i, (centre + 0.25 * rng.standard_normal(12)).tolist(), 1) for i in range(90)]
    data += [(100 + i, centre.tolist(), 1) for i in range(7)] + [(110, (centre * 3).tolist(), 1), (111, centre.tolist(), 2), (112, centre.tolist(), None), (113, (centre * 1e200).tolist(), 2)]
    data += [(120, None, 1), (121, [], 1), (122, [0.0] * 12, 1), (123, [float("nan")] + [1.0] * 11, 1), (124, [None] + [1.0] * 11, 1), (125, [float("inf")] * 12, 1), (126, [1.0, 2.0], 1), (127, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*d, 9, "x") for d in data], "vec_id long, embedding array<double>, label int, node int, links string").repartition(3)
    assert got(E.near_vectors(df)) == brute([d for d in data])


@pytest.mark.parametrize("n", [10, 10_000, 10**7])
def test_plan(n):
    bits, tables = E.plan_tables(n)
    assert (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables <= E.MISS


def test_empty(spark, empty_dir):
    assert E.op10_embedding_dedup(spark, empty_dir).count() == 0
