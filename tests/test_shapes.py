"""Voxel shapes, components and covariances against numpy and plain walks; samples and noise."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandwork.functions import scalar
from strandwork.operators import connectivity, tracklets, voxels


def cloud(seed, n=300, t=0):
    rng = np.random.default_rng(seed)
    at = {(int(rng.integers(0, 6)), int(rng.integers(0, 9)), int(rng.integers(0, 9))) for _ in range(n)}
    return [(t, *p, int(rng.integers(1, 90)), int(rng.integers(0, 4))) for p in sorted(at)]


def table(spark, rows):
    return spark.createDataFrame(rows, "t long, z long, y long, x long, value long, label long")


def test_moments_by_numpy(spark):
    rows = cloud(1) + cloud(2, t=1)
    rows = [(t, z, y + (x if lab == 1 else 0), x, v, lab) for t, z, y, x, v, lab in rows]
    found = {(r.t, r.label): r for r in voxels.shape_moments(table(spark, rows)).collect()}
    groups = defaultdict(list)
    for t, *p, _, lab in rows:
        groups[t, lab].append(p)
    for key, p in groups.items():
        if key[1] == 0:
            continue
        w, u = np.linalg.eigh(np.cov(np.array(p, float), rowvar=False))
        r = found[key]
        assert np.allclose([r.eigen_first, r.eigen_second, r.eigen_third], w[::-1]) and np.allclose([r.eccentricity_first, r.eccentricity_second, r.eccentricity_third], np.sqrt(w[::-1]))
        assert np.allclose([r.cell_axis_z, r.cell_axis_y, r.cell_axis_x], np.degrees(np.arccos(np.abs(u[:, 2]))), atol=1e-6)


def test_axis_of_a_ball_is_null(spark):
    rows = [(0, z, y, x, 1, 1) for z in range(3) for y in range(3) for x in range(3)]
    r = voxels.shape_moments(table(spark, rows)).first()
    assert r.cell_axis_z is None and abs(r.eigen_first - r.eigen_third) < 1e-9
    assert voxels.shape_moments(table(spark, rows[:3])).count() == 0


def test_largest_component_by_walking(spark):
    rows = cloud(5, 160) + cloud(6, 220, 1)
    expected = set()
    for t in (0, 1):
        on, seen, best = {tuple(r[1:4]) for r in rows if r[0] == t and r[5] > 0}, set(), []
        for p in sorted(on):
            if p in seen:
                continue
            part, queue = {p}, [p]
            while queue:
                at = queue.pop()
                for axis in range(3):
                    for s in (-1, 1):
                        q = tuple(c + s * (i == axis) for i, c in enumerate(at))
                        if q in on and q not in part:
                            part.add(q)
                            queue.append(q)
            seen |= part
            if len(part) > len(best):
                best = part
        expected |= {(t, *p) for p in best}
    assert {(r.t, r.z, r.y, r.x) for r in voxels.largest_component(table(spark, rows)).collect()} == expected


def test_boundary_samples(spark):
    df = table(spark, cloud(8, 400))
    edge = {(r.label, r.z, r.y, r.x) for r in voxels.boundary_pairs(df).collect()}
    found = [(r.label, r.z, r.y, r.x) for r in voxels.sample_boundary(df, 7).collect()]
    sizes = defaultdict(int)
    for e in edge:
        sizes[e[0]] += 1
    assert set(found) <= edge and len(found) == len(set(found)) == sum(min(7, n) for n in sizes.values())


def test_eigenvectors(spark):
    rng = np.random.default_rng(3)
    rows = [(h, i, i, *map(float, rng.standard_normal(3))) for h in range(4) for i in range(12 if h else 1)]
    df = spark.createDataFrame(rows, "head long, frame long, spot_id long, a double, b double, c double")
    cov = {r.head: np.array(r.covariance, float).reshape(3, 3) for r in tracklets.covariance_vector(df, ["a", "b", "c"]).collect() if r.head}
    for r in tracklets.covariance_eigen(tracklets.covariance_vector(df, ["a", "b", "c"])).collect():
        if not r.head:
            assert r.eigenvalues is None and r.eigenvectors is None
            continue
        w, u = np.array(r.eigenvalues), np.array(r.eigenvectors)
        assert (np.diff(w) <= 0).all() and np.allclose(u @ u.T, np.eye(3)) and np.allclose(cov[r.head] @ u.T, u.T * w)


def test_bars_of_spanning_trees(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, *map(float, rng.uniform(0, 10, 3))) for i in range(40)]
    points = spark.createDataFrame(rows, "spot_id long, frame long, z double, y double, x double")
    bars = connectivity.component_barcode(points, connectivity.rips_edges(points, 6.0))
    expected = defaultdict(list)
    for f in (0, 1):
        at = [r for r in rows if r[1] == f]
        links = sorted((float(np.linalg.norm(np.subtract(a[2:], b[2:]))), a[0], b[0]) for a in at for b in at if a[0] < b[0])
        root = {r[0]: r[0] for r in at}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for d, a, b in links:
            if d <= 6 and find(a) != find(b):
                root[find(a)] = find(b)
                expected[f].append(d)
    found = defaultdict(list)
    for r in bars.collect():
        found[r.frame].append(r.death)
    assert all(np.allclose(sorted(found[f]), sorted(expected[f])) for f in (0, 1))
    top = connectivity.persistence_stats(bars, 3).collect()
    assert sorted(round(r.persistence, 9) for r in top) == sorted(round(d, 9) for f in (0, 1) for d in sorted(expected[f])[-3:])


def test_noise(spark):
    df = spark.range(4000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    noisy = scalar.add_noise(df, ["y"], 0.5, 3).agg(F.avg("y").alias("m"), F.stddev("y").alias("s")).first()
    assert abs(noisy.m - 1) < 0.05 and abs(noisy.s - 0.5) < 0.05
    assert scalar.add_noise(df, ["y"], 0.0) is df
