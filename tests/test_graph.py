"""Forests, wedges, spectra and walks against plain Python; work that shrinks or stays bounded."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.operators import cluster, connectivity, kinematics, lineage
from strandwork.plans import registry
from strandwork.plans.fixtures import views


def kruskal(nodes, edges):
    root, out = {n: n for n in nodes}, []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, a, b, f in sorted({(d, min(a, b), max(a, b), f) for f, a, b, d in edges}):
        if a in root and b in root and a != b and find(a) != find(b):
            root[find(a)] = find(b)
            out.append((f, d))
    return sorted(out)


@pytest.mark.parametrize("ties", [False, True])
def test_barcode(spark, ties):
    """Ties, repeated edges, loops, edges of unknown points, points alone."""
    rng = random.Random(3)
    nodes = [(i, i % 3) for i in range(90)]
    edges = [(f, a, b, float(rng.randrange(3)) if ties else rng.random()) for f in range(3) for a, b in ((rng.choice(range(f, 90, 3)), rng.choice(range(f, 90, 3))) for _ in range(60))]
    edges += edges[:5] + [(0, 0, 999, 0.5), (0, 3, 3, 0.1)]
    got = connectivity.component_barcode(spark.createDataFrame(nodes, "spot_id long, frame long"), spark.createDataFrame(edges, "frame long, a long, b long, distance double"))
    assert sorted((r.frame, r.death) for r in got.collect()) == kruskal([n for n, _ in nodes], edges)
    assert connectivity.component_barcode(spark.createDataFrame(nodes, "spot_id long, frame long"), spark.createDataFrame([], "frame long, a long, b long, distance double")).count() == 0


def test_barcode_of_the_whole_table(spark, sf):
    v = views(spark, sf)
    edges = [(r.frame, r.a, r.b, r.distance) for r in connectivity.rips_edges(connectivity.frame_points(v.spots), 12.0).collect()]
    got = registry.QUERIES["component_barcode"](spark, sf).collect()
    want = kruskal([r.spot_id for r in v.spots.collect()], edges)
    assert np.allclose(sorted((r.frame, r.death) for r in got), [(f, round(d, 6)) for f, d in want])


def test_edges_shrink_by_round(spark):
    """A long path: parts at least halve each round, so there are few rounds, and edges go with them."""
    n = 3000
    rng = random.Random(1)
    parts = spark.createDataFrame([(i, i + 1, (rng.random(), i, i + 1, 0)) for i in range(n - 1)], "a long, b long, e struct<distance: double, a: long, b: long, frame: long>")
    sizes = [n - 1]
    while sizes[-1]:
        _, parts = connectivity.forest_round(parts)
        sizes.append(parts.count())
        assert sizes[-1] <= sizes[-2] / 2
    assert len(sizes) <= 13


def test_wedges_are_bounded(spark):
    """A star has no wedge from its crowded centre; counts of triangles are those of plain Python."""
    star = spark.range(1, 2000).select(F.lit(0).alias("frame"), F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert connectivity.wedges(star, ["frame"]).count() == 0
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(250)} | {(0, i) for i in range(1, 40)}
    edges = spark.createDataFrame([(0, a, b, 1.0) for a, b in pairs], "frame long, a long, b long, distance double")
    points = spark.range(40).select(F.col("id").alias("spot_id"), F.lit(0).cast("long").alias("frame"))
    r = connectivity.simplex_counts(points, edges, [0.5, 1.0]).orderBy("scale").collect()
    triangles = sum((a, b) in pairs and (b, c) in pairs and (a, c) in pairs for a in range(40) for b in range(a, 40) for c in range(b, 40))
    assert [(x.edges, x.triangles) for x in r] == [(0, 0), (len(pairs), triangles)]
    assert connectivity.wedges(edges, ["frame"]).count() <= 2 * len(pairs) ** 1.5


def test_spectrum_in_parts(spark):
    """Keys of one row to 10^5, whole and dealt to parts (lengths with and without a divisor), nulls as 0."""
    rng = np.random.default_rng(1)
    series = {"one": rng.random(1), "two": rng.random(2), "prime": rng.random(31), "long": rng.random(60), "nulls": np.array([1.0, np.nan, 2.0, 3.0])}
    rows = [(k, i, None if x != x else float(x)) for k, v in series.items() for i, x in enumerate(v)]
    for most in (1 << 16, 16):
        got = defaultdict(dict)
        for r in kinematics.intensity_spectrum(spark.createDataFrame(rows, "key string, i long, value double"), 2.0, most).collect():
            got[r.key][r.k] = (r.frequency, r.magnitude)
        for k, v in series.items():
            want = np.abs(np.fft.fft(np.nan_to_num(v)))[: max(1, len(v) // 2)]
            assert sorted(got[k]) == list(range(len(want)))
            assert np.allclose([got[k][i][1] for i in range(len(want))], want) and np.allclose([got[k][i][0] for i in range(len(want))], [i / (2.0 * len(v)) for i in range(len(want))])
    wave = spark.range(100_000).select(F.lit("x").alias("key"), F.col("id").alias("i"), F.sin(F.col("id") * 0.3).alias("value"))
    top = kinematics.intensity_spectrum(wave).orderBy(F.desc("magnitude")).first()
    assert abs(top.frequency - 0.3 / (2 * np.pi)) < 1e-5


def test_intervals_of_long_and_wide_trees(spark):
    """A chain of 300, a node of 200 children, a lone spot, a merge (the smaller parent counts)."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(2000, 2002), (2001, 2002)]
    spots = spark.createDataFrame([(i,) for i in sorted({x for e in edges for x in e} | {5000})], "spot_id long")
    got = {r.spot_id: r for r in lineage.intervals(spots, spark.createDataFrame([(0, a, b) for a, b in edges], "track_id long, source_id long, target_id long")).collect()}
    assert [(got[i].enter, got[i].leave, got[i].root) for i in (0, 299, 300)] == [(0, 601, 0), (299, 302, 0), (300, 301, 0)]
    assert [(got[i].enter, got[i].leave) for i in (1000, 1001, 1200)] == [(0, 401), (1, 2), (399, 400)]
    assert (got[5000].enter, got[5000].leave, got[5000].root) == (0, 1, 5000)
    assert got[2002].root == 2000 and (got[2001].enter, got[2001].leave) == (0, 1)


def test_clusters_and_forests_by_plain_python(spark, sf):
    """k-means has come to rest at its own centroids; the forest tells what is apart; spreads of views are mean distances to centroids."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((50, 3)) + 9 * np.eye(3)[k] for k in range(3)])
    df = spark.createDataFrame([(i, i // 50, [float(a) for a in v]) for i, v in enumerate(x)], "id long, label int, vector array<double>")
    got = {r.id: r.cluster for r in cluster.k_clusters(df, 3).collect()}
    c = np.array([got[i] for i in range(150)])
    centre = np.array([x[c == k].mean(axis=0) for k in range(3)])
    assert (((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1) == c).all()
    found = {r.id: r.prediction for r in cluster.classify_forest(df, df.where("id % 2 = 0"), trees=10).select("id", "prediction").collect()}
    assert np.mean([found[i] == i // 50 for i in range(150)]) > 0.95
    views_ = {"a": df, "b": df.withColumn("vector", F.slice("vector", 1, 2))}
    labels = {n: {r.id: r.cluster for r in cluster.k_clusters(v, 3).collect()} for n, v in views_.items()}
    for r in cluster.three_view_clusters(views_, 3).collect():
        y = x if r.measured_in == "a" else x[:, :2]
        mine = y[[i for i in range(150) if labels[r["view"]][i] == r.cluster]]
        assert abs(r.spread - np.sqrt(((mine - mine.mean(axis=0)) ** 2).sum(axis=1)).mean()) < 1e-6
