"""Comparison of two trackings: metrics over whole assignments, equal tracks among them."""

import random

import pytest
from pyspark.sql import functions as F

from strandwork.operators import analysis

COSTS = [(1, 11, 0.1), (1, 12, 0.2), (2, 11, 0.3), (2, 12, 0.9), (3, 13, 2.0)]


def test_metrics_take_the_whole_assignment(spark):
    """Track 2 gets its partner in the second round only; track 3's is too far to be a match, track 4 has none."""
    assigned = analysis.assign_tracks(spark.createDataFrame(COSTS, "track_id long, other_id long, cost double"), 1.5)
    spans = spark.createDataFrame([(1, 0, 5), (2, 0, 7), (3, 1, 2), (4, 0, 9)], "track_id long, start long, stop long")
    others = spark.createDataFrame([(11, 0, 5), (12, 0, 7), (13, 1, 2)], "track_id long, start long, stop long")
    assert analysis.complete_tracks(assigned, spans, others).first().complete == 6 / 7
    truth = spark.createDataFrame([(1, 3, 100), (2, 4, 101), (3, 1, 102), (4, 8, 103)], "track_id long, frame long, spot_id long")
    found = spark.createDataFrame([(11, 3, 200), (12, 5, 201), (13, 1, 202)], "track_id long, frame long, spot_id long")
    recall, precision = 2 / 4, 2 / 3
    assert abs(analysis.branching_f1(truth, found, assigned).first().f1 - 2 * recall * precision / (recall + precision)) < 1e-12


def test_queries_assign_in_rounds(spark, sf, monkeypatch):
    from strandwork.plans import registry

    asked = []
    whole = analysis.assign_alike
    monkeypatch.setattr(analysis, "assign_alike", lambda *a, **k: asked.append(1) or whole(*a, **k))
    for name in ("complete_tracks", "branching_f1"):
        registry.QUERIES[name](spark, sf)
    assert len(asked) == 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_tracks_are_assigned_as_all(spark, seed):
    """Clouds of one to four tracks whose ids interleave, costs with many ties: as taking the cheapest free pair of all tracks one at a time does."""
    rng = random.Random(seed)
    ids = [rng.sample(range(100), 30), rng.sample(range(200, 300), 30)]
    groups = []
    for side in ids:
        groups.append([])
        while side:
            n = min(rng.randrange(1, 5), len(side))
            groups[-1].append(sorted(side[:n]))
            del side[:n]
    costs = [(a[0], b[0], rng.randrange(1, 6) / 2 if seed < 3 else rng.random()) for a in groups[0] for b in groups[1] if rng.random() < 0.6]
    of = [{g[0]: g for g in side} for side in groups]
    left, expected = sorted((c, x, y) for a, b, c in costs for x in of[0][a] for y in of[1][b]), []
    while left:
        expected.append(left[0])
        left = [p for p in left if p[1] != left[0][1] and p[2] != left[0][2]]
    sides = [spark.createDataFrame([(t, g[0]) for g in side for t in g], "track_id long, cloud long") for side in groups]
    found = analysis.assign_alike(spark.createDataFrame(costs, "track_id long, other_id long, cost double"), *sides, 1.5)
    assert sorted((r.cost, r.track_id, r.other_id) for r in found.collect()) == sorted(expected)


def test_costs_of_equal_tracks(spark, monkeypatch):
    """Tracks that are copies, and one of the same places in another frame: costs are those of each with each; only clouds meet."""
    rng = random.Random(9)
    shapes = [[(f, rng.randrange(4) * 1.0, rng.randrange(4) * 1.0, 1.0) for f in range(5)] for _ in range(4)]
    shapes.append([(f + 1, *p) for f, *p in shapes[0]])
    rows = [(100 * t + i, t, *p) for t in range(15) for i, p in enumerate(shapes[t % 5])]
    truth = spark.createDataFrame(rows, "spot_id long, track_id long, frame long, z double, y double, x double")
    found = truth.where("track_id <> 3").select("spot_id", (F.col("track_id") + 50).alias("track_id"), "frame", "z", "y", (F.col("x") + F.col("track_id") % 5 / 4).alias("x"))
    assert {(r.track_id, r.cloud) for r in analysis.alike(truth).collect()} == {(t, t % 5) for t in range(15)}
    want = sorted(map(tuple, analysis.cloud_costs(truth, found, 2.0).collect()))
    assert want and sorted(map(tuple, analysis.cloud_distance(truth, found, 2.0).collect())) == want
    costs, tracks, others = analysis.cloud_distances(truth, found, 2.0)
    assert costs.count() < len(want) / 6
    every = spark.createDataFrame(want, costs.schema)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(analysis.mutual_nearest(costs)) == key(analysis.mutual_nearest(every))
    assert key(analysis.assign_alike(costs, tracks, others, 1.0)) == key(analysis.assign_tracks(every, 1.0))
