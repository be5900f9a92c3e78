"""Rows at one place: results are those of all rows, and places are met once."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandwork.operators import connectivity, space

SCHEMA = "spot_id long, track_id long, frame long, z double, y double, x double"


@pytest.fixture(scope="module")
def crowd(spark):
    """Spots of two frames at few places, up to nine at one; places without z, a number or an end besides."""
    rng = random.Random(6)
    spots = [(i, i % 7, i % 2, float(rng.randrange(3)), float(rng.randrange(3)), float(rng.randrange(2))) for i in range(90)]
    spots += [(100, 1, 0, None, 1.0, 1.0), (101, 2, 0, None, 1.0, 1.0), (102, 1, 0, math.nan, 1.0, 1.0), (103, 2, 0, math.inf, 1.0, 1.0), (104, 3, 0, math.inf, 1.0, 1.0)]
    return spots, spark.createDataFrame(spots, SCHEMA)


def gap(a, b):
    return math.nan if None in a[3:] + b[3:] else math.sqrt(sum((u - v) * (u - v) for u, v in zip(a[3:], b[3:])))


@pytest.mark.parametrize("plan", ["frame", "grid"])
@pytest.mark.parametrize("pack", [2, 1024])
def test_pairs_of_crowded_places(crowd, monkeypatch, plan, pack):
    monkeypatch.setattr(space.packs, "__defaults__", (*space.packs.__defaults__[:-1], pack))
    spots, df = crowd[0][:-2], crowd[1].where("spot_id < 103")
    pairs = [(a, b) for a in spots for b in spots if a[2] == b[2] and gap(a, b) <= 1.0]
    edges = connectivity.rips_edges(df, 1.0, plan=plan).collect()
    assert sorted((r.frame, r.a, r.b, r.distance) for r in edges) == sorted((a[2], a[0], b[0], gap(a, b)) for a, b in pairs if a[0] < b[0])
    near = space.neighbours_within(df, 1.0, plan=plan).collect()
    assert sorted((r.spot_id, r.frame, r.track_id) for r in near) == sorted({(a[0], a[2], b[1]) for a, b in pairs})


def test_complexes_of_crowded_places(crowd):
    spots, df = crowd
    points = connectivity.frame_points(df.where("spot_id < 60 or spot_id > 99"))
    rows = [s for s in spots if (s[0] < 60 or s[0] > 99) and s[0] not in (100, 101, 102)]  # frame_points() takes neither null nor NaN
    edges = connectivity.rips_edges(points, 1.5)
    key = lambda df: sorted((r.frame, r.birth, r.death) for r in df.collect())
    assert key(connectivity.barcodes(points, 1.5)) == key(connectivity.component_barcode(points, edges))
    at = connectivity.places(points)
    assert at.agg(F.sum("n")).first()[0] == len(rows) and at.count() < len(rows) / 2
    scales = [0.0, 1.0, 1.5]
    want = []
    for frame, scale in itertools.product((0, 1), scales):
        mine = [s for s in rows if s[2] == frame]
        near = {(a[0], b[0]) for a, b in itertools.combinations(mine, 2) if gap(a, b) <= scale}
        three = sum((a[0], b[0]) in near and (b[0], c[0]) in near and (a[0], c[0]) in near for a, b, c in itertools.combinations(mine, 3))
        want.append((frame, scale, len(mine), len(near), three, len(mine) - len(near) + three))
    for found in (connectivity.simplex_counts(at, connectivity.rips_edges(at, 1.5), scales), connectivity.simplex_counts(points, edges, scales)):
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_copies_make_no_more_rows(spark, crowd, monkeypatch):
    """Forests of places with each point ten times over begin with no more edges than with one."""
    points = connectivity.frame_points(crowd[1])
    sizes, whole = [], connectivity.component_barcode
    monkeypatch.setattr(connectivity, "component_barcode", lambda p, e: sizes.append(e.count()) or whole(p, e))
    connectivity.barcodes(points, 1.5)
    connectivity.barcodes(points.withColumn("spot_id", F.explode(F.sequence(F.col("spot_id") * 10, F.col("spot_id") * 10 + 9))), 1.5)
    assert sizes[0] == sizes[1]


def test_follow_makes_its_moves_once(spark, monkeypatch):
    """Places of moves are written once for all steps; paths are those of step by step predictions."""
    from strandwork.operators import analysis

    moves = spark.createDataFrame([(t, 0.0, 0.0, float(t + s), 0.0, 0.0, t + s + 1.0) for t in range(4) for s in (0, 3)], "t long, from_z double, from_y double, from_x double, to_z double, to_y double, to_x double")
    start = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.2), (2, 1, 0.0, 0.0, 4.0), (3, 0, 0.0, 9.0, 0.0)], "id long, frame long, z double, y double, x double")
    made, whole = [], analysis.places_of
    monkeypatch.setattr(analysis, "places_of", lambda m: made.append(1) or whole(m))
    found = {(r.id, r.frame): r.x for r in analysis.follow(start, moves, 1.0, 3).collect()}
    assert len(made) == 1 and set(found) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), (3, 0)}
    assert found[1, 3] == pytest.approx(3.0) and found[2, 4] == pytest.approx(7.0)
