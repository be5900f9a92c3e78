"""User encoders, metrics and class maps; near vectors by balls; silhouettes from sums; each against plain numpy."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandwork.operators import blocks, cluster, encode


def table(spark, x, groups=None, extra=()):
    rows = [(i, 0 if groups is None else int(groups[i]), [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), "id long, label int, vector array<double>")


def test_encoder_is_built_once_a_worker(spark, tmp_path):
    """Many tasks and batches, one call of the factory in each Python process; state arrives as it was."""
    log = str(tmp_path)

    def build(state):
        import uuid

        open(f"{state['log']}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return encode.linear(state["weights"])

    w = np.arange(6.0).reshape(3, 2)
    x = np.random.default_rng(1).standard_normal((500, 3))
    df = table(spark, x).repartition(16)
    got = {r.id: r.latent for r in encode.encode(df, build, {"log": log, "weights": w}, 2).collect()}
    assert np.allclose([got[i] for i in range(500)], x @ w)
    calls = [os.path.basename(p).split("-")[0] for p in glob.glob(f"{log}/*")]
    assert calls and len(calls) == len(set(calls)) and len(calls) < 16


def test_encoder_nulls_and_types(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, None, "y"), (3, [1.0, None], "z")], "id int, vector array<double>, latent string")
    got = {r.id: r.out for r in encode.encode(df, encode.linear, [[1.0], [1.0]], 1, out="out").collect()}
    assert got == {1: [3.0], 2: None, 3: None}
    assert encode.encode(df.limit(0), encode.linear, [[1.0]]).collect() == []
    for build, state, width in ((encode.linear, [[1.0], [1.0]], 3), (lambda s: lambda x: x[0], None, None), (lambda s: lambda x: x.astype(str), None, None), (lambda s: 7, None, None), (lambda s: lambda x: x[:0], None, None)):
        with pytest.raises(Exception, match="TypeError"):
            encode.encode(df, build, state, width).collect()
    with pytest.raises(Exception, match="different lengths"):
        encode.encode(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, vector array<double>").coalesce(1), encode.linear, [[1.0]]).collect()


def test_class_maps(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 9)], "id int, label int")
    read = lambda d: {r.id: r.class_name for r in d.collect()}
    names = {0: "Basal", 1: "Radial"}
    assert read(encode.map_classes(df, names, default="?")) == {1: "Basal", 2: "Radial", 3: "?", 4: "?"}
    table_ = spark.createDataFrame([(0, "b"), (0, "a"), (None, "none")], "from int, to string")
    assert read(encode.map_classes(df, table_)) == {1: "a", 2: None, 3: "none", 4: None}
    assert encode.reversed_map({2: "x", 1: "x", 3: "y"}) == {"x": 1, "y": 3}
    assert read(encode.map_classes(df, {}, default="d")) == dict.fromkeys((1, 2, 3, 4), "d")


@pytest.mark.parametrize("size", [4, 1000])
@pytest.mark.parametrize("symmetric", [True, False])
def test_user_metric(spark, monkeypatch, size, symmetric):
    monkeypatch.setattr(blocks, "BLOCK", size)
    x = np.random.default_rng(2).standard_normal((15, 4))
    x[3, 1:] = 0
    groups = [i % 2 if i else 5 for i in range(15)]
    metric = cluster.skipping("cosine", 1) if symmetric else (lambda u, v: u[:, :1] - v[:, 0][None, :])
    got = {(r.label, r.a, r.b): r.distance for r in cluster.pairwise_metric(table(spark, x, groups), ["label"], metric, symmetric).collect()}
    want = {}
    for i in range(15):
        for j in range(15):
            if groups[i] == groups[j] and (i < j if symmetric else i != j):
                u, v = x[i, 1:], x[j, 1:]
                norms = np.linalg.norm(u) * np.linalg.norm(v)
                want[groups[i], i, j] = (1 - u @ v / norms if norms else 0.0) if symmetric else x[i, 0] - x[j, 0]
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    with pytest.raises(Exception, match="shape"):
        cluster.pairwise_metric(table(spark, x), ["label"], lambda u, v: u).collect()


def clusters(d, limit, groups):
    root = list(range(len(d)))
    for _ in root:
        new = [min([root[i]] + [root[k] for k in range(len(d)) if groups[i] == groups[k] and d[i, k] < limit]) for i in range(len(d))]
        if new == root:
            break
        root = new
    return dict(enumerate(root))


@pytest.mark.parametrize("metric,limit", [("euclidean", 0.9), ("cosine", 0.05), ("user", 0.9)])
def test_threshold_clusters_by_balls(spark, monkeypatch, metric, limit):
    """Small blocks, so that groups fall into balls: chains over many balls, copies, vectors without length."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = np.concatenate((np.c_[np.arange(40) * 0.8, np.zeros((40, 2))], rng.standard_normal((60, 3)) * 3, np.ones((10, 3))))
    groups = np.r_[np.zeros(70, int), np.ones(40, int)]
    if metric == "cosine":
        x[100] = 0
    series = pd.Series(list(x))
    d = cluster.matrix(series, series, "euclidean" if metric == "user" else metric)
    got = cluster.threshold_clusters(table(spark, x, groups), ["label"], limit, (lambda u, v: cluster.matrix(pd.Series(list(u)), pd.Series(list(v)))) if metric == "user" else metric)
    assert {r.id: r.cluster for r in got.collect()} == clusters(d, limit, groups)


def test_balls_spare_comparisons(spark, monkeypatch):
    """On 40 clusters of 50 vectors far under n * n pairs are met, and every near pair is."""
    monkeypatch.setattr(blocks, "BLOCK", 64)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((40, 8)) * 20, 50, axis=0) + rng.standard_normal((2000, 8)) * 0.3
    df = table(spark, x).withColumn("at", F.col("vector"))
    placed = cluster.in_balls(df, ["label"], 1.0).select("ball", "home", "id").toPandas()
    met, n = 0, 0
    balls = {b: (g.id.to_numpy(), g.id[g.home].to_numpy()) for b, g in placed.groupby("ball")}
    d = np.sqrt(np.maximum(((x ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None] - 2 * x @ x.T), 0))
    seen = np.zeros((2000, 2000), bool)
    for all_, home in balls.values():
        met += len(all_) * len(home)
        seen[np.ix_(all_, home)] = True
    assert (seen | seen.T)[d < 1.0].all()
    assert met < 2000 * 2000 / 8, met


def plain_silhouette(d, labels):
    out = []
    for i, y in enumerate(labels):
        mean = {z: np.mean([d[i, k] for k in range(len(labels)) if labels[k] == z and k != i]) for z in set(labels) if any(labels[k] == z and k != i for k in range(len(labels)))}
        if y not in mean or len(mean) < 2:
            out.append(0.0)
            continue
        a, b = mean[y], min(m for z, m in mean.items() if z != y)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("metric", ["euclidean", "squared", "cosine"])
@pytest.mark.parametrize("size,far", [(5, 0.0), (1000, 1e5)])
def test_silhouettes(spark, monkeypatch, metric, size, far):
    """Overlapping labels, a label of one row, a vector without length, data far from 0."""
    monkeypatch.setattr(blocks, "BLOCK", size)
    rng = np.random.default_rng(3)
    labels = [i % 4 for i in range(60)] + [9]
    x = rng.standard_normal((61, 3)) + np.array(labels)[:, None] * 1.5 + far
    if metric == "cosine":
        x[5] = 0
    s = pd.Series(list(x))
    d = cluster.matrix(s, s, "cosine" if metric == "cosine" else "euclidean")
    d = d ** 2 if metric == "squared" else d
    got = cluster.silhouette(table(spark, x, labels), metric, "label").first()[0]
    assert abs(got - plain_silhouette(d, labels)) < 1e-6


@pytest.mark.parametrize("metric,limit", [("euclidean", 1.2), ("cosine", 0.05)])
def test_near_pairs(spark, monkeypatch, metric, limit):
    """Over many balls: the pairs closer than limit, each once, with vectors without length and copies."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = np.concatenate((rng.standard_normal((70, 3)) * 2, np.ones((8, 3)), np.zeros((2, 3))))
    groups = [i % 2 for i in range(80)]
    s = pd.Series(list(x))
    d = cluster.matrix(s, s, metric)
    got = cluster.near_pairs(table(spark, x, groups), ["label"], limit, metric).collect()
    want = {(groups[i], i, j): d[i, j] for i in range(80) for j in range(i + 1, 80) if groups[i] == groups[j] and d[i, j] < limit}
    assert len(got) == len(want) and {(r.label, r.a, r.b) for r in got} == set(want)
    assert np.allclose([r.distance for r in got], [want[r.label, r.a, r.b] for r in got])


@pytest.mark.parametrize("metric", ["euclidean", "user"])
@pytest.mark.parametrize("k", [1, 5, 200])
def test_nearest_vectors(spark, monkeypatch, k, metric):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(10)
    x = np.concatenate((rng.standard_normal((60, 3)), rng.standard_normal((60, 3)) + 15, np.ones((6, 3))))
    df = table(spark, x, [i % 3 for i in range(126)])
    got = cluster.nearest_vectors(df, df.where("id % 2 = 0"), k, metric=metric if metric == "euclidean" else (lambda u, v: cluster.matrix(pd.Series(list(u)), pd.Series(list(v))))).collect()
    s = pd.Series(list(x))
    d = cluster.matrix(s, s)
    want = {(i, j): d[i, j] for i in range(126) for _, j in sorted((round(d[i, j], 12), j) for j in range(0, 126, 2) if j != i)[:k]}
    assert len(got) == len(want) and {(r.id, r.other) for r in got} == set(want)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pairs_in_blocks_and_odd_ones(spark, monkeypatch, metric):
    """All pairs, in blocks of four, as the join of rows has them; vectors that are null, short, without length or with odd parts, ids and labels that are null or come twice."""
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), [float(x) for x in rng.standard_normal(5)]) for i in range(60)]
    rows += [(60, 0, None), (61, 0, [1.0, 2.0]), (62, 0, [0.0] * 5), (63, 1, [1.0, None, 0.0, 0.0, 0.0]), (64, 1, [float("nan")] * 5), (65, 1, [float("inf")] + [0.0] * 4), (66, None, [1.0] * 5), (None, 2, [1.0] * 5), (1, 1, [2.0] * 5), (2, 2, [1e200] * 5)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    a, b = df.select("label", F.col("id").alias("a"), F.col("vector").alias("u")), df.select("label", F.col("id").alias("b"), F.col("vector").alias("v"))
    want = a.join(b, "label").where("a < b").select("label", "a", "b", cluster.vector_distance(F.col("u"), F.col("v"), metric).alias("distance"))
    key = lambda df: sorted(((r.label, r.a, r.b, None if r.distance is None else repr(round(r.distance, 9) + 0.0)) for r in df.collect()), key=repr)
    monkeypatch.setattr(blocks, "BLOCK", 4)
    found = cluster.pairwise_distance(df, ["label"], metric)
    assert key(found) == key(want)
    plain = cluster.pairwise_distance(df.where("id between 3 and 59"), ["label"], metric)
    assert "FlatMapCoGroupsInPandas" in plain._jdf.queryExecution().toString() and "zip_with" not in plain._jdf.queryExecution().toString()
