"""Larger and odder tables than the given ones: what operators hand to the driver, and how many rows their rounds write, on tables where that once grew out of bounds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandwork.operators import lineage as L
from strandwork.operators import analysis, blocks, cluster, connectivity, series, space, summary, tables, voxels
from strandwork.plans import fixtures, registry
from strandwork.plans.catalog_analysis import full
from strandwork.plans.catalog_series import lives


@pytest.mark.parametrize("name", ["within", "label_density", "crop_patches"])
def test_exploded_queries_are_not_broadcast(spark, tmp_path, name):
    """A query's 27 cells are rows that no estimate of its table's size counts: that side goes by shuffle."""
    spark.range(2_000).selectExpr("id as spot_id", "id % 3 as frame", "cast(id % 20 as double) as z", "cast(id % 30 as double) as y", "cast(id % 40 as double) as x").write.parquet(f"{tmp_path}/s")
    spark.range(2_000).selectExpr("id % 3 as t", "id % 4 as z", "id % 32 as y", "id % 31 as x", "id as value", "id % 5 as label").write.parquet(f"{tmp_path}/v")
    spots, v = spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/v")
    made = {"within": lambda: space.within(spots, spots, 5.0, plan="grid"), "label_density": lambda: space.label_density(spots, v, 2.0), "crop_patches": lambda: voxels.crop_patches(spots.withColumnRenamed("frame", "t"), v, "spot_id", (1, 2, 1))}
    plan = made[name]()._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    explodes = [i for i, x in enumerate(lines) if "Generate explode" in x]
    assert explodes
    for i in explodes:  # the first join or broadcast above an explode
        depth, above = len(lines[i]) - len(lines[i].lstrip(" :+-")), []
        for j in range(i - 1, -1, -1):
            d = len(lines[j]) - len(lines[j].lstrip(" :+-"))
            if d < depth:
                depth = d
                above.append(lines[j])
        assert next(x for x in above if "Join" in x or "BroadcastExchange" in x).lstrip(" :+-").startswith("SortMergeJoin")


def test_rows_of_spots_are_not_broadcast(spark, sf):
    """Views with a row for each spot are joined by shuffle, also where their files are small; tables with a row for each frame or histogram still go to all."""
    v = fixtures.Views(spark, sf)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = [full(v), tables.properties(v.spots, v.edges, v.pieces, v.motion), space.within(v.spots, v.pred_spots, 3.0), L.tracklet_spans(v.pieces, v.spots), v.pred_edges]
    for df in joined:
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    few = [summary.feature_histogram(v.spots.select("frame", F.lit("x").alias("feature"), F.col("x").alias("value"))), analysis.apply_translation(v.spots, v.spots.groupBy("frame").agg(F.avg("y").alias("drift_y"), F.avg("x").alias("drift_x"))), connectivity.frame_points(v.spots, True)]
    for df in few:
        assert "SortMergeJoin" not in plan(df)


def test_known_is_planned_in_parts(spark, sf, monkeypatch):
    """What the driver plans anew after each stage stays short: regions, mask and density are tables of their own before the spots take them."""
    joins, write = {}, L.saved

    def counted(df, name):
        joins[name] = df._jdf.queryExecution().executedPlan().toString().count("Join ")
        return write(df, name)

    monkeypatch.setattr(L, "saved", counted)
    v = fixtures.Views(spark, sf)
    assert v.known.count() == v.spots.count()
    assert {"shapes", "mask", "density"} <= set(joins) and joins["known"] <= 10


def test_lives_need_no_motion(spark, sf):
    """Lives of tracklets come from pieces and frames alone: no speeds or angles are made for them."""
    v = fixtures.Views(spark, sf)
    assert lives(v).count() == v.pieces.select("head").distinct().count()
    assert "motion" not in vars(v)


def test_hops_stay_as_few_as_spots(spark, monkeypatch):
    """One line of 300 spots has 44,850 pairs of ancestors; of its last spot there are 299, and no round writes more than a few rows a spot."""
    edges, rows = spark.range(299).selectExpr("id as source_id", "id + 1 as target_id"), []
    kept = L.saved

    def counted(df, name):
        out = kept(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(L, "saved", counted)
    up = L.ancestors_of(edges, spark.createDataFrame([(299,)], "spot_id long"))
    assert {r.ancestor for r in up.collect()} == set(range(299))
    down = L.descendants_of(edges, spark.createDataFrame([(0,)], "spot_id long"))
    assert {r.descendant for r in down.collect()} == set(range(1, 300))
    assert max(rows) <= 299


def test_reached_over_merges(spark):
    """Several ways of unequal length, and a spot asked twice: each pair once."""
    hops = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (2, 5), (5, 6)], "spot_id long, other long")
    asked = spark.createDataFrame([(1,), (4,), (1,), (9,)], "spot_id long")
    assert sorted(map(tuple, L.reached(hops, asked).collect())) == [*[(1, n) for n in range(2, 7)], (4, 5), (4, 6)]
    assert L.reached(hops.where(F.lit(False)), asked).count() == 0


@pytest.mark.parametrize("name", ["threshold_clusters", "threshold_clusters_euclidean"])
def test_clusters_of_odd_vectors(spark, sf, tmp_path, name):
    """Rows without label, vector, length or finite parts are rows of the result, as in SQL."""
    odd = F.when(F.col("vec_id") % 7 == 1, F.lit(None)).when(F.col("vec_id") % 7 == 2, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 11 == 3, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    table = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("embedding", odd).withColumn("label", F.when(F.col("vec_id") % 5 != 0, F.col("label")))
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = c.sql(registry.SQL[name])
    assert sorted(tuple(r[x] for x in expected.columns) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(expected.fetchall())


def test_copies_of_vectors_ask_once(spark, monkeypatch):
    """40 copies of 5 vectors: the matrices that are made hold a few rows a vector, not all copies against all, and the nearest are right."""
    ids = [(i, float(i % 5)) for i in range(200)]
    df = spark.createDataFrame([(i, [v, 0.0], i % 2) for i, v in ids], "id long, vector array<double>, label int")
    met, kept = [], cluster.in_blocks
    monkeypatch.setattr(cluster, "in_blocks", lambda a, b, *rest, **more: (met.append(a.count() * b.count()), kept(a, b, *rest, **more))[1])
    found = cluster.nearest_vectors(df, df, 3).collect()
    expected = {(i, o) for i, v in ids for _, o in sorted((abs(v - w), j) for j, w in ids if j != i)[:3]}
    assert {(r.id, r.other) for r in found} == expected and len(found) == 600
    assert max(met) <= 5 * 20


def test_correlations_shuffle_once(spark):
    """All lags come from windows over a key's rows: one shuffle by key, on odd series (gaps, repeated and null places, null values, one row) what a join of rows with rows gives."""
    rows = [(h, i, v) for h, s in enumerate(([1.0, 4.0, 2.0, 7.0, 3.0], [2.0, None, 5.0, 1.0], [3.0, 3.0, 3.0], [9.0])) for i, v in enumerate(s)]
    rows += [(7, i, float(i * i % 5)) for i in (0, 1, 3, 3, 4, 8)] + [(8, None, 1.0), (8, 0, 2.0), (8, 1, 5.0), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "head long, i long, value double")
    found = analysis.autocorrelation(df, 3)
    expected = {}
    for h in {r[0] for r in rows} - {None}:
        own = [(i, v) for k, i, v in rows if k == h]
        mean = sum(v for _, v in own if v is not None) / sum(v is not None for _, v in own)
        square = sum((v - mean) ** 2 for _, v in own if v is not None)
        for lag in range(min(3, len(own) - 1) + 1):
            met = [(v, w) for i, v in own for j, w in own if i is not None and j is not None and j == i + lag]
            if met:
                both = [(v - mean) * (w - mean) for v, w in met if v is not None and w is not None]
                expected[h, lag] = round(sum(both) / square, 9) if both and square else None
    assert {(r["head"], r.lag): None if r.acf is None else round(r.acf, 9) + 0.0 for r in found.collect()} == expected
    wide = df.withColumn("other", F.col("value") * F.col("i"))
    for plan in (found, series.cross_correlation(wide, ["value", "other"], 3)):
        assert plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["anderson_darling", "generation_report"])
def test_series_read_their_rows_once(spark, name):
    """What many parts of a report need is written once, not made again for each."""
    seen = spark.sparkContext.accumulator(0)

    def passed(r):
        seen.add(1)
        return r

    made = spark.sparkContext.parallelize([(t % 5, t, t, t % 2, float(t * t % 17), float(t * 7 % 13)) for t in range(60)], 2).map(passed)
    df = spark.createDataFrame(made, "head long, frame long, spot_id long, generation long, u double, v double")
    spans = spark.range(5).selectExpr("id as head", "55L as life")
    found = series.anderson_darling(df, ["generation"], "u") if name == "anderson_darling" else series.generation_report(df, spans, ["u", "v"])
    assert found.count() > 0 and seen.value == 60


def test_copies_of_places_are_met_as_one(spark, monkeypatch):
    """30 copies of 4 sources and 30 of 2 queries: 8 pairs, not 7,200; predictions are those of all of them."""
    spots = [(i % 4, float(i % 4), float(i)) for i in range(120)]
    moves = spark.createDataFrame([(5, x, 0.0, 0.0, to, 1.0, None if int(to) % 3 else 2.0) for _, x, to in spots], "t long, from_z double, from_y double, from_x double, to_z double, to_y double, to_x double")
    asked = spark.createDataFrame([(i, 5, 0.5 if i % 2 else 3.0, 0.0, 0.0) for i in range(60)] + [(99, 6, 0.0, 0.0, 0.0), (98, 5, None, 0.0, 0.0)], "id long, frame long, z double, y double, x double")
    met, kept = [], space.within
    monkeypatch.setattr(space, "within", lambda *a, **k: (met.append(kept(*a, **k).count()), kept(*a, **k))[1])
    found = {r.id: (r.z, r.y, r.x) for r in analysis.radius_predict(asked, moves, 9.0).collect()}
    assert met == [8] and len(found) == 62 and found[99] == found[98] == (None, None, None)
    for i in range(60):
        at = 0.5 if i % 2 else 3.0
        w = [1e10 if x == at else 1 / abs(x - at) for _, x, _ in spots]
        want = [sum(a * b for a, b in zip(w, part)) / sum(w) for part in ([to for _, _, to in spots], [1.0] * 120, [0.0 if int(to) % 3 else 2.0 for _, _, to in spots])]
        assert found[i] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("name", ["near_pairs", "nearest_vectors"])
def test_visits_of_balls_carry_no_vectors(spark, monkeypatch, name):
    """1,000 rows that visit most of some 30 balls: a Python task gives back no more rows with vectors than it was given."""
    monkeypatch.setattr(blocks, "BLOCK", 64)
    df = spark.range(1000).selectExpr("id", "0 as label", "array(cast(id * 37 % 101 as double), cast(id * 53 % 97 as double)) as vector")
    made, kept = [], cluster.in_blocks

    def counted(a, b, by, make, schema, **more):
        if "array<" in schema:
            made.append(kept(a, b, by, make, schema, **more).count())
        else:
            made.append(0)
        return kept(a, b, by, make, schema, **more)

    monkeypatch.setattr(cluster, "in_blocks", counted)
    found = cluster.near_pairs(df, ["label"], 40.0) if name == "near_pairs" else cluster.nearest_vectors(df, df, 300)
    assert found.count() > 100_000 and len(made) == 3 and max(made) == 1000


def test_silhouette_copies_rows_by_wide_blocks(spark, monkeypatch):
    """640 rows of one label and 10 of another, in blocks of 16: each goes with 3 wide blocks at most, not with all 40, and the score is right."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    x = [(i, int(i >= 640), [float(i * 37 % 101), float(i * 53 % 97)]) for i in range(650)]
    df, copies, kept = spark.createDataFrame(x, "id long, label int, vector array<double>"), [], cluster.in_blocks

    def counted(a, b, by, make, schema, **more):
        if "total double" in schema:
            copies.append(-(-640 // (more.get("size") or blocks.BLOCK)))
        return kept(a, b, by, make, schema, **more)

    monkeypatch.setattr(cluster, "in_blocks", counted)
    got = cluster.silhouette(df, label="label").first()[0]
    score = 0.0
    for i, y, v in x:
        mean = {z: sum(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2) ** 0.5 for k, z2, w in x if z2 == z and k != i) / ((640, 10)[z] - (z == y)) for z in (0, 1)}
        score += (mean[1 - y] - mean[y]) / max(mean.values())
    assert copies == [3] and abs(got - score / 650) < 1e-9
