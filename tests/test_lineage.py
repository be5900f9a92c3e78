"""Hand-made lineages, and properties of random forests."""

import random

import pytest

from strandwork.operators import kinematics as K
from strandwork.operators import lineage as L
from strandwork.operators import space as P


def make(spark, links, frames=None, track=1):
    """spots and edges of (source, target) links; the frame of a spot is its depth unless given."""
    ids = sorted({i for e in links for i in e})
    up = {b: a for a, b in links}

    def depth(i):
        return 0 if i not in up else depth(up[i]) + 1

    spots = spark.createDataFrame([(i, track, (frames or {}).get(i, depth(i)), 0.0, float(i), 0.0) for i in ids], "spot_id long, track_id long, frame long, z double, y double, x double")
    return spots, spark.createDataFrame([(track, a, b) for a, b in links], "track_id long, source_id long, target_id long")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


CASES = {
    "chain": ([(1, 2), (2, 3)], {1: (0, 1), 2: (0, 1), 3: (0, 1)}),
    "split": ([(1, 2), (2, 3), (2, 4)], {1: (0, 1), 2: (0, 1), 3: (1, 3), 4: (1, 4)}),
    "two splits": ([(1, 2), (1, 3), (2, 4), (2, 5), (3, 6)], {1: (0, 1), 2: (1, 2), 3: (1, 3), 4: (2, 4), 5: (2, 5), 6: (1, 3)}),
}


@pytest.mark.parametrize("name", CASES)
def test_generations(spark, name):
    links, expected = CASES[name]
    spots, edges = make(spark, links)
    assert got(L.tracklets(spots, edges), "spot_id", "generation", "head") == sorted((k, *v) for k, v in expected.items())


def test_roots_leaves_splits_merges(spark):
    spots, edges = make(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (5, 6)])
    assert got(L.roots(edges), "spot_id") == [(1,), (5,)]
    assert got(L.leaves(edges), "spot_id") == [(4,), (6,)]
    assert got(L.splits(edges), "spot_id") == [(1,)]
    assert got(L.merges(edges), "spot_id") == [(4,)]
    assert got(L.ancestors_of(edges, L.leaves(edges)), "spot_id", "ancestor") == [(4, 1), (4, 2), (6, 5)]


def test_random_forest(spark):
    """A child's generation is its parent's and one more where it splits; heads are roots and children of splits."""
    rng = random.Random(7)
    links = [(rng.randrange(max(0, i - 4), i), i) for i in range(1, 120) if i % 17]
    spots, edges = make(spark, links)
    known = {r.spot_id: r for r in L.tracklets(spots, edges).collect()}
    kids = {}
    for a, b in links:
        kids.setdefault(a, []).append(b)
    for a, b in links:
        split = len(kids[a]) > 1
        assert known[b].generation == known[a].generation + split
        assert known[b].head == (b if split else known[a].head)


def test_gap_and_kinematics(spark):
    spots, edges = make(spark, [(1, 2), (2, 4)], {1: 0, 2: 1, 4: 3})
    assert got(L.gaps(edges, spots), "source_id", "frames") == [(2, 2)]
    found = {r.spot_id: r for r in K.kinematics(spots, edges).collect()}
    assert (found[1].speed, found[2].speed, found[4].speed) == (0.0, 1.0, 1.0)
    assert found[4].acceleration == pytest.approx(1 / 3) and found[2].motion_angle_y == 0.0
    msd = {r.spot_id: (r.msd, r.recoil) for r in K.root_displacement(spots, edges).collect()}
    assert msd == {1: (0.0, 0.0), 2: (1.0, 1.0), 4: (9.0, 3.0)}


def test_empty(spark):
    spots, edges = make(spark, [(1, 2)])
    assert L.tracklets(spots.limit(0), edges.limit(0)).count() == 0
    assert K.kinematics(spots, edges.limit(0)).where("speed = 0").count() == 2


def test_plans_agree(spark):
    """Frame plan, grid plan and all pairs give the same rows; no plan has a cross join."""
    rng = random.Random(2)
    points = [(i, rng.randrange(3), *(rng.uniform(-9, 9) for _ in range(3))) for i in range(150)]
    df = spark.createDataFrame(points, "spot_id long, frame long, z double, y double, x double")
    expected = sorted((a[0], b[0]) for a in points for b in points if abs(a[1] - b[1]) <= 1 and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= 16)
    for plan in ("frame", "grid"):
        pairs = P.within(df, df, 4.0, 1, plan=plan)
        assert got(pairs, "q_spot_id", "p_spot_id") == expected
        assert "Cartesian" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()
    near = {}
    for a in points:
        near[a[0]] = sorted((sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) ** 0.5, b[0]) for b in points if b[1] == a[1])[:3]
    found = P.knn(df.withColumnRenamed("spot_id", "id"), df, 3).collect()
    assert sorted((r.q_id, r.p_spot_id) for r in found) == sorted((k, b) for k, v in near.items() for _, b in v)
