"""Work in blocks and by ranks against plain Python, with any block size; plans of space joins."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwork.operators import analysis, blocks, cluster, series, space, summary


def points(spark, n, frames=3, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(frames), rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "spot_id long, frame long, z double, y double, x double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), max_size=40))
def test_ranks_and_quantiles(spark, values):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(values)], "i int, g string, v int")
    groups = defaultdict(list)
    for i, (g, v) in enumerate(values):
        groups[g].append((v is not None, v or 0, i))
    expected = {i: r for g, rows in groups.items() for r, (*_, i) in enumerate(sorted(rows), 1)}
    assert {r.i: r["rank"] for r in blocks.ranked(df, ["g"], ["v", "i"]).collect()} == expected
    known = {g: [v for h, v in values if h == g and v is not None] for g in ("a", "b")}
    found = {r.g: (r.lo, r.mid) for r in blocks.quantiles(df.where("g is not null"), ["g"], "v", {"lo": 0.1, "mid": 0.5}).collect()}
    assert found.keys() == {g for g, vs in known.items() if vs}
    for g, pair in found.items():
        assert np.allclose(pair, np.quantile(known[g], [0.1, 0.5]))


def test_before_in_order(spark):
    rng = random.Random(3)
    ids = rng.sample(range(500), 60)
    rows = [(i, i % 2, float(rng.random())) for i in ids]
    found = {r.i: r.prior_v for r in blocks.before_in_order(spark.createDataFrame(rows, "i long, g long, v double"), ["g"], "i", ["v"], 16).collect()}
    for g in (0, 1):
        last = None
        for i, _, v in sorted(r for r in rows if r[1] == g):
            assert found[i] == last
            last = v


@pytest.mark.parametrize("size", [3, 1000])
def test_blocks_of_any_size(spark, monkeypatch, size):
    """Clusters, votes and silhouettes don't depend on how rows are dealt."""
    monkeypatch.setattr(blocks, "BLOCK", size)
    rng = np.random.default_rng(5)
    data = [(i, int(i % 3), (rng.standard_normal(4) + 4 * (i % 3)).tolist()) for i in range(40)]
    df = spark.createDataFrame(data, "id long, label int, vector array<double>")
    x = np.array([v for *_, v in data])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    root = list(range(40))
    for _ in range(40):
        for i in range(40):
            root[i] = min(root[k] for k in range(40) if d[i, k] < 2.0)
    assert {r.id: r.cluster for r in cluster.threshold_clusters(df, [], 2.0).collect()} == dict(enumerate(root))
    score = []
    for i, (_, y, _) in enumerate(data):
        mean = {z: np.mean([d[i, k] for k in range(40) if data[k][1] == z and k != i]) for z in (0, 1, 2)}
        a, b = mean[y], min(m for z, m in mean.items() if z != y)
        score.append((b - a) / max(a, b))
    assert abs(cluster.silhouette(df, label="label").first()[0] - np.mean(score)) < 1e-9
    votes = {r.id: r.label for r in cluster.classify_knn(df, df.where("id % 2 = 0"), 3).collect()}
    for i in range(40):
        near = sorted((d[i, k], k) for k in range(0, 40, 2) if k != i)[:3]
        count = defaultdict(int)
        for _, k in near:
            count[data[k][1]] += 1
        assert votes[i] == min(count, key=lambda y: (-count[y], y))
    k, chosen = cluster.choose_k(df, [2, 3, 4])
    assert k == 3 and chosen.select("cluster").distinct().count() == 3
    assert cluster.choose_k(df.limit(0).union(df.limit(1)), []) == (None, None)


def test_sample_is_balanced(spark):
    df = spark.range(3000).select(F.col("id").alias("head"), (F.col("id") % 10 == 0).alias("flag"))
    for ratio, want in ((1.5, 450), (0.0, 0), (100.0, 2700)):
        found = summary.class_balanced_sample(df, "flag", ratio).groupBy("flag").count().collect()
        count = {r.flag: r["count"] for r in found}
        assert count[True] == 300 and count.get(False, 0) == want
    first = {r.head for r in summary.class_balanced_sample(df, "flag", 1.5).collect()}
    assert first == {r.head for r in summary.class_balanced_sample(df.repartition(7), "flag", 1.5).collect()}


@pytest.mark.parametrize("frames", [0, 1])
def test_crowded_frames_take_the_grid(spark, monkeypatch, frames):
    """Whichever plan a frame gets, the pairs are the same, and the same as by plain Python."""
    rows, df = points(spark, 90, 4)
    df = df.withColumn("frame", F.when(F.col("spot_id") < 50, 0).otherwise(F.col("frame")))
    rows = [(i, 0 if i < 50 else f, *p) for i, f, *p in rows]
    monkeypatch.setattr(space, "FRAME_PLAN_PAIRS", 30)
    found = sorted((r.q_spot_id, r.p_spot_id, r.gap) for r in space.within(df, df, 6.0, frames).collect())
    expected = sorted((a[0], b[0], abs(a[1] - b[1])) for a in rows for b in rows if abs(a[1] - b[1]) <= frames and sum((u - v) ** 2 for u, v in zip(a[2:], b[2:])) <= 36)
    assert found == expected


def test_space_joins_are_equi_joins(spark):
    _, df = points(spark, 200)
    for plan in ("frame", "grid", "auto"):
        text = space.within(df, df, 3.0, plan=plan)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text, plan
    assert "NestedLoop" not in cluster.silhouette(spark.createDataFrame([(1, 0, [1.0]), (2, 1, [2.0])], "id long, cluster int, vector array<double>"))._jdf.queryExecution().toString()


def test_trend_normality_and_report(spark):
    rng = np.random.default_rng(2)
    rows = [(h, i, float(v)) for h in range(6) for i, v in enumerate(rng.standard_normal(20) + 0.1 * h)]
    df = spark.createDataFrame(rows, "head long, i long, value double")
    fitted = {(r.head, r.i): r.fitted for r in series.polynomial_trend(df, 6).collect()}
    for h in range(6):
        y = np.array([v for k, _, v in rows if k == h])
        u = np.linspace(-1, 1, 20)
        assert np.allclose([fitted[h, i] for i in range(20)], np.polyval(np.polyfit(u, y, 6), u), atol=1e-6)
    import math

    pool = df.withColumn("g", F.col("head") % 2)
    found = {r.g: (r.n, r.statistic) for r in series.anderson_darling(pool, ["g"], "value").collect()}
    for g in (0, 1):
        v = np.sort([x for h, _, x in rows if h % 2 == g])
        z, n = (v - v.mean()) / v.std(ddof=1), len(v)
        logs = lambda t: np.log([0.5 * math.erfc(-x / math.sqrt(2)) for x in t])
        k = np.arange(1, n + 1)
        assert found[g][0] == n and abs(found[g][1] - (-n - ((2 * k - 1) * (logs(z) + logs(-z[::-1]))).sum() / n)) < 1e-8


def test_assignment_and_hits(spark):
    rng = random.Random(4)
    costs = [(a, 100 + b, round(rng.random(), 3)) for a in range(12) for b in range(9) if rng.random() < 0.7]
    left, expected = sorted(costs, key=lambda c: (c[2], c[0], c[1])), []
    while left:  # the cheapest pair is always mutual
        best = left[0]
        expected.append(best)
        left = [c for c in left if c[0] != best[0] and c[1] != best[1]]
    df = spark.createDataFrame(costs, "track_id long, other_id long, cost double")
    found = analysis.assign_tracks(df, 0.5)
    assert sorted((r.track_id, r.other_id, r.cost, r.matched) for r in found.collect()) == sorted((*c, c[2] <= 0.5) for c in expected)
    total = analysis.hits(found).first()
    assert (total.matched, total.assigned) == (sum(c[2] <= 0.5 for c in expected), len(expected)) and abs(total.total_cost - sum(c[2] for c in expected)) < 1e-9


def test_generation_report(spark):
    """First tracklets that last and later ones, pooled: autocorrelation, slope and covariance by numpy; of one cell type only its own."""
    rng = np.random.default_rng(8)
    rows = [(h, t, 100 * h + t, int(h > 3), float(rng.standard_normal()), float(rng.standard_normal()), "ab"[h % 2]) for h in range(8) for t in range(1 if h == 0 else 10)]
    df = spark.createDataFrame(rows, "head long, frame long, spot_id long, generation long, u double, v double, cell_type string")
    spans = df.groupBy("head").agg((F.max("frame") - F.min("frame")).alias("life"))
    for kind in (None, "a"):
        found = {(r.later, r.kind, r.feature): r for r in series.generation_report(df, spans, ["u", "v"], 3, kind).collect()}
        for later in (False, True):
            heads = [h for h in range(1, 8) if (h > 3) == later and (kind is None or "ab"[h % 2] == kind)]
            u = {h: np.array([r[4] for r in rows if r[0] == h]) for h in heads}
            v = {h: np.array([r[5] for r in rows if r[0] == h]) for h in heads}
            acf = [((x[:-k] - x.mean()) * (x[k:] - x.mean())).sum() / ((x - x.mean()) ** 2).sum() for x in u.values() for k in (1, 2, 3)]
            r = found[later, "autocorrelation", "u"]
            assert r.tracklets == len(heads) and abs(r["mean"] - np.mean(acf)) < 1e-9 and abs(r["std"] - np.std(acf)) < 1e-9 and r.statistic is not None
            slopes = [np.polyfit(range(10), x, 1)[0] for x in u.values()]
            assert abs(found[later, "slope", "u"]["mean"] - np.mean(slopes)) < 1e-9
            cov = [np.cov(u[h], v[h])[0, 1] for h in heads]
            assert abs(found[later, "covariance", "u,v"]["mean"] - np.mean(cov)) < 1e-9
            assert found[later, "cross-correlation", "v"].tracklets == len(heads)
