"""Queries of summaries, tracklets, voxels and analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import kinematics as K
from ..operators import lineage as L
from ..operators import summary as U
from ..operators import tracklets as T
from ..operators import voxels as X
from .catalog_lineage import SPANS, STEPS
from .catalog_space import REGIONS
from .registry import register

FEATURES = ["radius", "speed", "acceleration", "motion_angle_x"]
FULL = "(SELECT p.spot_id, p.track_id, p.head, p.generation, p.tracklet_no, s.frame, s.z, s.y, s.x, radius, intensity, cell_type, speed, acceleration, motion_angle_z, motion_angle_y, motion_angle_x, (row_number() OVER (PARTITION BY p.head ORDER BY s.frame, p.spot_id) - 1) AS i, count(*) OVER (PARTITION BY p.head) AS n FROM pieces p JOIN spots s USING (spot_id) JOIN motion m USING (spot_id))"


def full(v):
    """Spots with their tracklet and motion."""
    return v.pieces.select("spot_id", "head", "generation", "tracklet_no").join(v.spots.select("spot_id", "track_id", "frame", "z", "y", "x", "radius", "intensity", "cell_type"), "spot_id").join(v.motion.drop("track_id", "frame"), "spot_id")


def q(name, make, needs, sql, doubles=""):
    register(name, make, needs, sql, doubles)


ON = "pieces motion"
q("frame_counts", lambda v: U.frame_counts(v.spots), "spots", "SELECT frame, count(*) AS spots FROM spots GROUP BY 1")
q("division_counts", lambda v: U.division_counts(v.spots.withColumns({"dividing": F.col("track_id") % 3 == 0, "z": F.lit(0), "y": F.floor(F.col("y") / 10), "x": F.floor(F.col("x") / 20)})), "spots",
  "SELECT frame, CAST(count(*) AS DOUBLE) / 2 AS divisions FROM (SELECT frame, count(*) OVER (PARTITION BY frame, floor(y / 10), floor(x / 20)) AS n FROM spots WHERE track_id % 3 = 0) WHERE n > 1 GROUP BY 1", "divisions")
q("split_snapshot", lambda v: U.split_snapshot(v.motion, L.splits(v.edges)).select("spot_id", "speed", "acceleration"), "motion edges", "SELECT spot_id, speed, acceleration FROM motion WHERE spot_id IN (SELECT source_id FROM edges GROUP BY 1 HAVING count(*) > 1)", "speed acceleration")
q("values_by_cell_type", lambda v: U.values_by(full(v), "cell_type", ["speed", "acceleration"]), ON, f"SELECT cell_type, unnest(['speed', 'acceleration']) AS feature, unnest([speed, acceleration]) AS value FROM {FULL} WHERE cell_type IS NOT NULL", "value")
DIV = "(SELECT track_id, count(source_id) AS divisions FROM (SELECT DISTINCT track_id FROM spots) LEFT JOIN (SELECT track_id, source_id FROM edges GROUP BY ALL HAVING count(*) > 1) USING (track_id) GROUP BY 1)"
q("values_by_division_count", lambda v: U.values_by(v.motion.join(L.division_label(v.spots, v.edges), "track_id"), "number_dividing", ["speed"]).withColumnRenamed("number_dividing", "divisions"), "motion spots edges", f"SELECT divisions, 'speed' AS feature, speed AS value FROM motion JOIN {DIV} USING (track_id)", "value")
q("feature_histogram", lambda v: U.feature_histogram(U.values_by(v.spots, "cell_type", ["x", "y", "intensity"]), 20, ("cell_type", "feature")), "spots",
  """WITH v AS (SELECT cell_type, unnest(['x', 'y', 'intensity']) AS feature, unnest([x, y, intensity]) AS value FROM spots WHERE cell_type IS NOT NULL), e AS (SELECT *, min(value) OVER (PARTITION BY cell_type, feature) AS lo, max(value) OVER (PARTITION BY cell_type, feature) AS hi FROM v)
  SELECT cell_type, feature, CAST(least(19, coalesce(floor((value - lo) / nullif(hi - lo, 0) * 20), 0)) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1, 2, 3""")  # fmt: skip
q("angle_histogram", lambda v: U.angle_histogram(v.motion, "radial_angle_x", 8), "motion",
  """WITH v AS (SELECT radians(radial_angle_x) AS value FROM motion WHERE frame = 8), e AS (SELECT *, min(value) OVER () AS lo, max(value) OVER () AS hi FROM v)
  SELECT CAST(least(9, coalesce(floor((value - lo) / nullif(hi - lo, 0) * 10), 0)) AS BIGINT) AS bin, count(*) AS n, avg(cos(value) * 20) AS arrow_x, avg(sin(value) * 20) AS arrow_y FROM e GROUP BY 1""", "arrow_x arrow_y")  # fmt: skip
q("quadrant_counts", lambda v: U.quadrant_counts(v.spots, 50.0, 100.0, "cell_type"), "spots", "SELECT frame, (y >= 50)::INTEGER * 2 + (x >= 100)::INTEGER AS quadrant, cell_type, count(*) AS n FROM spots GROUP BY ALL")
q("cluster_nearness", lambda v: U.cluster_nearness(v.spots, "cell_type"), "spots",
  """WITH c AS (SELECT frame, cell_type AS k, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM spots WHERE cell_type IS NOT NULL GROUP BY 1, 2)
  SELECT c.frame, c.k AS a, d.k AS b, sum(sqrt((c.z - d.z) ** 2 + (c.y - d.y) ** 2 + (c.x - d.x) ** 2)) OVER (PARTITION BY c.k, d.k ORDER BY c.frame) AS nearness FROM c JOIN c d ON c.frame = d.frame AND c.k < d.k""", "nearness")  # fmt: skip
q("cluster_sizes", lambda v: U.cluster_sizes(v.spots, "cell_type"), "spots", "SELECT cell_type, count(*) AS n FROM spots GROUP BY 1")
q("grid_raster", lambda v: U.grid_raster(v.spots, "cell_type"), "spots", "SELECT CAST(floor(frame) AS BIGINT) AS gt, CAST(floor(y / 10) AS BIGINT) AS gy, CAST(floor(x / 10) AS BIGINT) AS gx, arg_max_null(cell_type, spot_id) AS cell_type FROM spots GROUP BY 1, 2, 3")
q("path_heatmap", lambda v: U.path_heatmap(v.spots.withColumnRenamed("frame", "t")), "spots", "SELECT frame AS t, round_even(z, 0) AS z, round_even(y, 0) AS y, round_even(x, 0) AS x, count(*) AS hits FROM spots GROUP BY ALL", "z y x")
q("microdomains", lambda v: U.microdomains(full(v).withColumn("far", F.when(F.col("spot_id") % 5 != 0, F.col("x"))), "cell_type", "far", 5, 20).select("spot_id"), ON, f"SELECT min(spot_id) AS spot_id FROM {FULL} WHERE spot_id % 5 <> 0 AND frame BETWEEN 5 AND 20 GROUP BY frame, cell_type, head")
q("first_position", lambda v: U.first_position(v.spots, "cell_type"), "spots", "SELECT DISTINCT ON (track_id) track_id, cell_type, frame AS t, z, y, x FROM spots WHERE cell_type IS NOT NULL ORDER BY track_id, frame, spot_id", "z y x")
q("coalesce_window_labels", lambda v: U.coalesce_window_labels(v.spots.select("spot_id", "frame", (F.col("spot_id") % 3).alias("w10"), (F.col("spot_id") % 4).alias("w20")), {"w10": 10, "w20": 20}), "spots",
  "SELECT spot_id, frame, CASE WHEN frame <= 10 THEN 'w10' ELSE 'w20' END AS \"window\", CASE WHEN frame <= 10 THEN spot_id % 3 ELSE spot_id % 4 END AS label FROM spots WHERE frame <= 20")
q("region_of_interest", lambda v: U.region_of_interest(v.spots, frame=(3, 9), x=(10, 120), y=(5, 70)).select("spot_id"), "spots", "SELECT spot_id FROM spots WHERE frame BETWEEN 3 AND 9 AND x BETWEEN 10 AND 120 AND y BETWEEN 5 AND 70")
q("time_window", lambda v: U.region_of_interest(v.spots, frame=(4, 12)).select("spot_id"), "spots", "SELECT spot_id FROM spots WHERE frame BETWEEN 4 AND 12")
q("clip_roi", lambda v: U.clip_roi(v.spots.select((F.col("y") - 60).alias("y_start"), F.col("y").alias("y_end"), (F.col("x") - 60).alias("x_start"), F.col("x").alias("x_end")), v.voxels.agg(F.max("y").cast("double").alias("y_size"), F.max("x").cast("double").alias("x_size")), ["y", "x"]), "spots voxels",
  "SELECT greatest(0, y - 60) AS y_start, least(y, ys) AS y_end, greatest(0, x - 60) AS x_start, least(x, xs) AS x_end FROM spots, (SELECT CAST(max(y) AS DOUBLE) AS ys, CAST(max(x) AS DOUBLE) AS xs FROM voxels)", "y_start y_end x_start x_end")
q("select_features", lambda v: U.select_features(full(v).withColumn("radius", F.when(F.col("radius") > 0, F.col("radius"))), FEATURES, ["acceleration"]), ON, f"SELECT spot_id, radius, speed, motion_angle_x FROM {FULL} WHERE radius > 0", "radius speed motion_angle_x")
register("class_balanced_sample", lambda v: U.class_balanced_sample(L.tracklet_spans(v.pieces, v.spots).withColumns({"dividing": F.col("generation") > 2, "head": F.concat_ws("-", "track_id", "tracklet_no")}), "dividing", 1.0))

q("tracklet_series", lambda v: T.tracklet_series(full(v), ["speed"]).select("head", F.posexplode("series").alias("i", "s")).select("head", F.col("i").cast("long").alias("i"), "s.spot_id", "s.speed"), ON, f"SELECT head, i, spot_id, speed FROM {FULL}", "speed")
q("dividing_tracklets", lambda v: T.dividing_tracklets(full(v).withColumn("dividing", F.col("spot_id") % 11 == 0)).select("spot_id"), "pieces", "SELECT spot_id FROM pieces WHERE head IN (SELECT head FROM pieces WHERE spot_id % 11 = 0)")
q("blocks", lambda v: T.blocks(full(v), 3).select("spot_id", "block"), ON, f"SELECT spot_id, i // 3 AS block FROM {FULL} WHERE (i // 3 + 1) * 3 <= n")
q("sliding_windows", lambda v: T.sliding_windows(full(v), 3).select("head", "start", F.col("k").cast("long").alias("k"), "spot_id"), ON, f"SELECT head, i - k AS start, k, spot_id FROM {FULL}, range(0, 3) r(k) WHERE i - k >= 0 AND i - k <= n - 3")
q("fit_length", lambda v: T.fit_length(full(v), 6).select("head", "k", "spot_id"), ON, f"SELECT head, k, spot_id FROM {FULL}, range(0, 6) r(k) WHERE i = least(k, n - 1)")
q("centre_row", lambda v: T.centre_row(full(v), 6).select("head", "spot_id"), ON, f"SELECT head, spot_id FROM {FULL} WHERE i = least(3, n - 1)")
q("min_length", lambda v: T.min_length(full(v), 4).select("spot_id"), ON, f"SELECT spot_id FROM {FULL} WHERE n >= 4")
COV = f"SELECT head, i, j, covar_samp(a, b) AS covariance FROM (SELECT head, unnest([0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3]) AS i, unnest([0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3]) AS j, unnest([radius, radius, radius, radius, speed, speed, speed, speed, acceleration, acceleration, acceleration, acceleration, motion_angle_x, motion_angle_x, motion_angle_x, motion_angle_x]) AS a, unnest([radius, speed, acceleration, motion_angle_x, radius, speed, acceleration, motion_angle_x, radius, speed, acceleration, motion_angle_x, radius, speed, acceleration, motion_angle_x]) AS b FROM {FULL}) GROUP BY 1, 2, 3"
q("covariance_long", lambda v: T.covariance_long(full(v), FEATURES), ON, COV, "covariance")
q("covariance_vector", lambda v: T.covariance_vector(full(v), FEATURES).select("head", F.posexplode("covariance").alias("place", "covariance")), ON, f"SELECT head, i * 4 + j AS place, covariance FROM ({COV})", "covariance")
q("mean_covariance", lambda v: T.mean_covariance(T.covariance_long(full(v), FEATURES)), ON, f"SELECT i, j, avg(covariance) AS covariance FROM ({COV}) GROUP BY 1, 2", "covariance")
register("covariance_eigen", lambda v: T.covariance_eigen(T.covariance_vector(full(v), FEATURES)).select("head", F.posexplode(F.arrays_zip("eigenvalues", "eigenvectors")).alias("n", "e")).select("head", "n", F.col("e.eigenvalues").alias("value"), F.col("e.eigenvectors").alias("axis")))
q("raw_vector", lambda v: T.raw_vector(full(v), ["x", "y"], 4).select("head", F.posexplode("vector").alias("place", "value")), ON, f"SELECT head, CAST(k * 2 + c AS INTEGER) AS place, CASE c WHEN 0 THEN x ELSE y END AS value FROM {FULL}, range(0, 4) r(k), range(0, 2) s(c) WHERE i = least(k, n - 1)", "value")

q("regions", lambda v: X.regions(v.voxels), "voxels", REGIONS, "z y x mean_value")
q("min_size", lambda v: X.min_size(X.regions(v.voxels), 4, 7, 7).select("t", "label"), "voxels", f"SELECT t, label FROM ({REGIONS}) WHERE z_max - z_min >= 3 AND y_max - y_min >= 6 AND x_max - x_min >= 6")
NEAR = "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1"
EDGE = f"SELECT DISTINCT a.t, a.z * 2.0 AS z, a.y * 1.0 AS y, a.x * 0.5 AS x FROM voxels a JOIN voxels b ON a.t = b.t AND {NEAR} WHERE a.label > 0 AND b.label = 0"
EDGE = EDGE.replace("a.z * 2.0", "CAST(a.z AS DOUBLE) * 2").replace("a.y * 1.0", "CAST(a.y AS DOUBLE)").replace("a.x * 0.5", "CAST(a.x AS DOUBLE) / 2")
q("boundary_voxels", lambda v: X.boundary_voxels(v.voxels, (2.0, 1.0, 0.5)), "voxels", EDGE, "z y x")
q("centroid_of_boundary", lambda v: X.centroid_of_boundary(X.boundary_voxels(v.voxels, (2.0, 1.0, 0.5))), "voxels", f"SELECT t, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM ({EDGE}) GROUP BY 1", "z y x")
AREA = f"SELECT t, label, CAST(6 * count(*) - sum(same) AS DOUBLE) AS area FROM (SELECT a.t, a.label, (SELECT count(*) FROM voxels b WHERE b.t = a.t AND b.label = a.label AND {NEAR}) AS same FROM voxels a WHERE a.label > 0) GROUP BY 1, 2"
q("exposed_area", lambda v: X.exposed_area(v.voxels), "voxels", AREA, "area")
q("frame_mask", lambda v: X.frame_mask(v.voxels).select("t", "z", "y", "x"), "voxels", "SELECT t, z, y, x FROM voxels, (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM voxels) WHERE y > y0 AND y < y1 AND x > x0 AND x < x1")
q("cell_size", lambda v: X.cell_size(v.voxels), "voxels",
  """WITH c AS (SELECT * FROM voxels WHERE label > 0 AND (t = 0 OR t = (SELECT (max(t) + 1) // 2 FROM voxels))), s AS (SELECT t, label, row_number() OVER (PARTITION BY t ORDER BY count(*) DESC, label) AS r FROM c GROUP BY 1, 2), k AS (SELECT c.* FROM c JOIN s USING (t, label) WHERE r <= 10)
  SELECT coalesce(max(sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 50) AS cell_size FROM k a JOIN k b USING (t, label)""", "cell_size")  # fmt: skip
#: All places that each foreground voxel reaches, by their first; places as one number that keeps the order of (z, y, x).
PARTS = """SELECT * FROM (
 WITH RECURSIVE on_ AS (SELECT t, z, y, x, (z * 1000 + y) * 1000 + x AS p FROM voxels WHERE label > 0),
 e AS (SELECT a.t, a.p AS u, b.p AS v FROM on_ a JOIN on_ b ON a.t = b.t AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
 r AS (SELECT t, p, p AS q FROM on_ UNION SELECT r.t, e.v, r.q FROM r JOIN e ON e.t = r.t AND e.u = r.p),
 m AS (SELECT t, p, min(q) AS part FROM r GROUP BY 1, 2), b AS (SELECT DISTINCT ON (t) t, part FROM (SELECT t, part, count(*) AS n FROM m GROUP BY 1, 2) ORDER BY t, n DESC, part)
 SELECT on_.t, z, y, x FROM m JOIN b USING (t, part) JOIN on_ ON on_.t = m.t AND on_.p = m.p)"""
q("largest_component", lambda v: X.largest_component(v.voxels), "voxels", PARTS)
register("sample_boundary", lambda v: X.sample_boundary(v.voxels, 20))
q("centre_cloud", lambda v: X.centre_cloud(v.voxels.where("label > 0").select("t", "label", *[F.col(c).cast("double").alias(c) for c in "zyx"]), ["t", "label"]), "voxels", "SELECT t, label, z - avg(z) OVER w AS z, y - avg(y) OVER w AS y, x - avg(x) OVER w AS x FROM voxels WHERE label > 0 WINDOW w AS (PARTITION BY t, label)", "z y x")
q("box_at_point", lambda v: X.box_at_point(v.spots.select("spot_id", F.col("frame").alias("t"), (F.col("z") / 5).alias("z"), (F.col("y") / 4).alias("y"), (F.col("x") / 8).alias("x")), v.voxels, "spot_id"), "spots voxels",
  f"SELECT spot_id, r.label, y_max - y_min + 1 AS height, x_max - x_min + 1 AS width, z_max - z_min + 1 AS depth FROM spots s JOIN voxels b ON b.t = s.frame AND b.z = round_even(s.z / 5, 0) AND b.y = round_even(s.y / 4, 0) AND b.x = round_even(s.x / 8, 0) AND b.label > 0 JOIN ({REGIONS}) r ON r.t = b.t AND r.label = b.label")
q("crop_patches", lambda v: X.crop_patches(v.spots.select("spot_id", F.col("frame").alias("t"), (F.col("z") / 10 + 1).alias("z"), (F.col("y") / 4).alias("y"), (F.col("x") / 8).alias("x")), v.voxels, "spot_id", (1, 2, 1)).select("spot_id", "dz", "dy", "dx", "value"), "spots voxels",
  """WITH c AS (SELECT spot_id, b.z - round_even(s.z / 10 + 1, 0)::BIGINT AS dz, b.y - round_even(s.y / 4, 0)::BIGINT AS dy, b.x - round_even(s.x / 8, 0)::BIGINT AS dx, value FROM spots s JOIN voxels b ON b.t = s.frame AND b.z = round_even(s.z / 10 + 1, 0) AND b.x = round_even(s.x / 8, 0) AND b.y - round_even(s.y / 4, 0) BETWEEN -1 AND 0)
  SELECT spot_id, dz, dy, dx, value FROM (SELECT *, count(*) OVER (PARTITION BY spot_id) AS n FROM c) WHERE n = 2""")  # fmt: skip
q("percentile_normalise", lambda v: X.percentile_normalise(v.voxels).select("t", "z", "y", "x", "normalised"), "voxels",
  "SELECT t, z, y, x, (value - lo) / (hi - lo + 1e-20) AS normalised FROM voxels, (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.998) AS hi FROM voxels)", "normalised")

ENSEMBLE = f"SELECT cell_type, frame, avg(speed) AS speed FROM (SELECT cell_type, frame, head, avg(speed) AS speed FROM {FULL} WHERE cell_type IS NOT NULL GROUP BY ALL) GROUP BY 1, 2"
TIME = f"SELECT cell_type, start, avg(speed) AS speed FROM (SELECT cell_type, start, head, avg(speed) AS speed FROM (SELECT unnest(range(greatest(0, frame - 5), frame + 1)) AS start, * FROM {FULL} WHERE cell_type IS NOT NULL) WHERE start <= (SELECT max(frame) - 5 FROM spots) GROUP BY ALL) GROUP BY 1, 2"
q("ensemble_average", lambda v: A.ensemble_average(full(v), ["speed"]), ON, ENSEMBLE, "speed")
q("time_average", lambda v: A.time_average(full(v), ["speed"], 5), ON, TIME, "speed")
q("ergodicity_gap", lambda v: A.ergodicity_gap(full(v), ["speed"], 5), ON, f"SELECT e.cell_type, e.frame AS end_frame, abs(e.speed - t.speed) AS speed_gap FROM ({ENSEMBLE}) e JOIN ({TIME}) t ON t.cell_type = e.cell_type AND t.start + 5 = e.frame", "speed_gap")
PAIRS = "(SELECT a.spot_id AS qs, a.track_id AS track_id, b.spot_id AS ps, b.track_id AS other_id, sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d FROM spots a JOIN pred_spots b ON a.frame = b.frame AND sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) <= 3)"
COST = f"""SELECT track_id, other_id, greatest((a.s + (na - a.h) * 3) / na, (b.s + (nb - b.h) * 3) / nb) AS cost FROM
 (SELECT track_id, other_id, CAST(sum(d) AS DOUBLE) / 1e9 AS s, count(*) AS h FROM (SELECT track_id, other_id, qs, CAST(round(min(d) * 1e9) AS BIGINT) AS d FROM {PAIRS} GROUP BY ALL) GROUP BY 1, 2) a JOIN
 (SELECT track_id, other_id, CAST(sum(d) AS DOUBLE) / 1e9 AS s, count(*) AS h FROM (SELECT track_id, other_id, ps, CAST(round(min(d) * 1e9) AS BIGINT) AS d FROM {PAIRS} GROUP BY ALL) GROUP BY 1, 2) b USING (track_id, other_id)
 JOIN (SELECT track_id, count(*) AS na FROM spots GROUP BY 1) USING (track_id) JOIN (SELECT track_id AS other_id, count(*) AS nb FROM pred_spots GROUP BY 1) USING (other_id)"""
MUTUAL = f"SELECT track_id, other_id, cost FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(cost, 9), other_id) AS ra, row_number() OVER (PARTITION BY other_id ORDER BY round(cost, 9), track_id) AS rb FROM ({COST})) WHERE ra = 1 AND rb = 1"
PRED = "spots pred_spots"
costs = lambda v: A.cloud_distance(v.spots, v.pred_spots, 3.0)
q("cloud_distance", costs, PRED, COST, "cost")


def clouds(v):
    """Costs between clouds to 9 places, and the clouds of both trackings' tracks."""
    found, tracks, others = A.cloud_distances(v.spots, v.pred_spots, 3.0)
    return found.withColumn("cost", F.round("cost", 9)), tracks, others


# Of equal tracks only the one of the smallest id can be another's cheapest: the one that names their cloud.
q("mutual_nearest", lambda v: A.mutual_nearest(clouds(v)[0]), PRED, MUTUAL, "cost")
#: Rounds of mutual nearest pairs give what taking the cheapest free pair one at a time does.
ONE_TO_ONE = f"""SELECT * FROM (
 WITH RECURSIVE c AS MATERIALIZED (SELECT track_id, other_id, round(cost, 9) AS cost FROM ({COST})),
 g AS (
  SELECT CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub, CAST(NULL AS STRUCT(c DOUBLE, a BIGINT, b BIGINT)) AS e
  UNION ALL
  SELECT list_append(ua, m.a), list_append(ub, m.b), m FROM (SELECT g.ua, g.ub, (SELECT min({{'c': cost, 'a': track_id, 'b': other_id}}) FROM c WHERE NOT list_contains(g.ua, track_id) AND NOT list_contains(g.ub, other_id)) AS m FROM g) WHERE m IS NOT NULL)
 SELECT e.a AS track_id, e.b AS other_id, e.c AS cost, e.c <= 1.5 AS matched FROM g WHERE e IS NOT NULL)"""
assigned = lambda v: A.assign_alike(*clouds(v), 1.5)
q("assign_tracks", assigned, PRED, ONE_TO_ONE, "cost")
q("hits", lambda v: A.hits(assigned(v)), PRED, f"SELECT count(*) FILTER (matched) AS matched, count(*) AS assigned, sum(cost) AS total_cost FROM ({ONE_TO_ONE})", "total_cost")
ends = lambda s: s.groupBy("track_id").agg(F.min("frame").alias("start"), F.max("frame").alias("stop"))
q("complete_tracks", lambda v: A.complete_tracks(assigned(v), ends(v.spots), ends(v.pred_spots)), PRED,
  f"WITH a AS (SELECT track_id, min(frame) AS s, max(frame) AS e FROM spots GROUP BY 1), b AS (SELECT track_id AS other_id, min(frame) AS s, max(frame) AS e FROM pred_spots GROUP BY 1) SELECT CAST(2 * (SELECT count(*) FROM ({ONE_TO_ONE}) JOIN a USING (track_id) JOIN b USING (other_id) WHERE a.s = b.s AND a.e = b.e) AS DOUBLE) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)) AS complete", "complete")
lives = lambda s: ends(s).select((F.col("stop") - F.col("start")).alias("life"))
q("cycle_accuracy", lambda v: A.cycle_accuracy(lives(v.spots), lives(v.pred_spots)), PRED,
  """WITH c AS (SELECT life, sum(a) AS a, sum(b) AS b FROM (SELECT max(frame) - min(frame) AS life, 1 AS a, 0 AS b FROM spots GROUP BY track_id UNION ALL SELECT max(frame) - min(frame), 0, 1 FROM pred_spots GROUP BY track_id) GROUP BY 1)
  SELECT 1 - max(abs(ca / na - cb / nb)) AS accuracy FROM (SELECT CAST(sum(a) OVER (ORDER BY life) AS DOUBLE) AS ca, CAST(sum(b) OVER (ORDER BY life) AS DOUBLE) AS cb, CAST(sum(a) OVER () AS DOUBLE) AS na, CAST(sum(b) OVER () AS DOUBLE) AS nb FROM c)""", "accuracy")  # fmt: skip
EVENTS = "SELECT track_id, frame, spot_id FROM {s} WHERE spot_id IN (SELECT source_id FROM {e} GROUP BY 1 HAVING count(*) > 1)"
q("division_events", lambda v: A.division_events(v.spots, v.edges), "spots edges", EVENTS.format(s="spots", e="edges"))
q("branching_f1", lambda v: A.branching_f1(A.division_events(v.spots, v.edges), A.division_events(v.pred_spots, v.pred_edges), assigned(v)), "spots pred_spots edges pred_edges",
  f"""WITH m AS (SELECT * FROM ({ONE_TO_ONE}) WHERE matched), ea AS ({EVENTS.format(s='spots', e='edges')}), eb AS ({EVENTS.format(s='pred_spots', e='pred_edges')}), t AS (SELECT ea.* FROM ea JOIN m USING (track_id)), f AS (SELECT m.track_id, eb.frame, eb.spot_id FROM eb JOIN m ON m.other_id = eb.track_id),
  x AS (SELECT (SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM f WHERE f.track_id = t.track_id AND abs(f.frame - t.frame) <= 1)) / CAST((SELECT count(*) FROM ea) AS DOUBLE) AS r, (SELECT count(*) FROM f WHERE EXISTS (SELECT 1 FROM t WHERE f.track_id = t.track_id AND abs(f.frame - t.frame) <= 1)) / CAST((SELECT count(*) FROM eb) AS DOUBLE) AS p)
  SELECT coalesce(2 * r * p / nullif(r + p, 0), 0) AS f1 FROM x""", "f1")  # fmt: skip
q("majority_vote", lambda v: A.majority_vote(v.spots, "frame", "cell_type"), "spots", "SELECT frame, cell_type FROM (SELECT frame, cell_type, row_number() OVER (PARTITION BY frame ORDER BY count(cell_type) DESC, cell_type NULLS LAST) AS r FROM spots GROUP BY 1, 2) WHERE r = 1")
q("weighted_vote", lambda v: A.weighted_vote(v.spots, "frame", "cell_type", "seq"), "spots", "SELECT frame, coalesce(cell_type, 'UnClassified') AS cell_type FROM (SELECT frame, cell_type, row_number() OVER (PARTITION BY frame ORDER BY sum(CASE WHEN cell_type IS NOT NULL THEN seq END) DESC NULLS LAST, cell_type NULLS LAST) AS r FROM spots GROUP BY 1, 2) WHERE r = 1")
MOVES = "SELECT source_id, a.frame AS t, a.z AS from_z, a.y AS from_y, a.x AS from_x, b.z AS to_z, b.y AS to_y, b.x AS to_x FROM edges JOIN spots a ON a.spot_id = source_id JOIN spots b ON b.spot_id = target_id WHERE b.frame = a.frame + 1"
PLACES = "from_z from_y from_x to_z to_y to_x"
q("transitions", lambda v: A.transitions(v.spots, v.edges), "spots edges", MOVES, PLACES)
q("fill_transitions", lambda v: A.fill_transitions(v.spots, v.edges), "spots edges",
  f"""SELECT * FROM ({MOVES}) UNION ALL SELECT spot_id, frame, z, y, x, tz, ty, tx FROM (SELECT a.spot_id, a.frame, a.z, a.y, a.x, b.z AS tz, b.y AS ty, b.x AS tx, row_number() OVER (PARTITION BY a.spot_id ORDER BY sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), b.spot_id) AS r
  FROM spots a JOIN spots b ON b.frame = a.frame + 1 WHERE a.spot_id NOT IN (SELECT source_id FROM ({MOVES}))) WHERE r = 1""", PLACES)  # fmt: skip
q("radius_predict", lambda v: A.radius_predict(v.annotations.select(F.col("ann_id").alias("id"), F.col("t").alias("frame"), "z", "y", "x"), A.transitions(v.spots, v.edges), 12.0), "annotations spots edges",
  f"""WITH m AS ({MOVES}), p AS (SELECT ann_id, to_z, to_y, to_x, sqrt((z - from_z) * (z - from_z) + (y - from_y) * (y - from_y) + (x - from_x) * (x - from_x)) AS d FROM annotations a JOIN m ON m.t = a.t), w AS (SELECT *, CASE WHEN d = 0 THEN 1e10 ELSE 1 / d END AS w FROM p WHERE d <= 12)
  SELECT a.ann_id AS id, z, y, x FROM (SELECT ann_id FROM annotations) a LEFT JOIN (SELECT ann_id, sum(w * to_z) / sum(w) AS z, sum(w * to_y) / sum(w) AS y, sum(w * to_x) / sum(w) AS x FROM w GROUP BY 1) b USING (ann_id)""", "z y x")  # fmt: skip
STEP = """s{n} AS (SELECT id, frame + 1 AS frame, sum(w * to_z) / sum(w) AS z, sum(w * to_y) / sum(w) AS y, sum(w * to_x) / sum(w) AS x FROM
  (SELECT id, frame, to_z, to_y, to_x, CASE WHEN d = 0 THEN 1e10 ELSE 1 / d END AS w FROM (SELECT s.id, s.frame, m.*, sqrt((s.z - from_z) * (s.z - from_z) + (s.y - from_y) * (s.y - from_y) + (s.x - from_x) * (s.x - from_x)) AS d FROM s{p} s JOIN m ON m.t = s.frame) WHERE d <= 20) GROUP BY 1, frame)"""
q("follow", lambda v: A.follow(v.annotations.select(F.col("ann_id").alias("id"), F.col("t").alias("frame"), "z", "y", "x"), A.transitions(v.spots, v.edges), 20.0, 3), "annotations spots edges",
  f"WITH m AS ({MOVES}), s0 AS (SELECT ann_id AS id, t AS frame, z, y, x FROM annotations), {', '.join(STEP.format(n=n, p=n - 1) for n in (1, 2, 3))} FROM s0 UNION ALL FROM s1 UNION ALL FROM s2 UNION ALL FROM s3", "z y x")
DRIFT = f"""SELECT frame, sum(my) OVER (ORDER BY frame) AS drift_y, sum(mx) OVER (ORDER BY frame) AS drift_x FROM (SELECT to_frame AS frame, median(dy) AS my, median(dx) AS mx FROM ({STEPS}) GROUP BY 1 UNION ALL SELECT min(from_frame), 0, 0 FROM ({STEPS}))"""
steps = lambda v: K.edge_steps(v.spots, v.edges)
q("xy_drift", lambda v: A.xy_drift(steps(v)), "spots edges", DRIFT, "drift_y drift_x")
q("z_drift", lambda v: A.xy_drift(steps(v), ["z"]), "spots edges", f"SELECT frame, sum(m) OVER (ORDER BY frame) AS drift_z FROM (SELECT to_frame AS frame, median(dz) AS m FROM ({STEPS}) GROUP BY 1 UNION ALL SELECT min(from_frame), 0 FROM ({STEPS}))", "drift_z")
q("apply_translation", lambda v: A.apply_translation(v.spots, A.xy_drift(steps(v))).select("spot_id", "y", "x"), "spots edges", f"SELECT spot_id, y - coalesce(drift_y, 0) AS y, x - coalesce(drift_x, 0) AS x FROM spots LEFT JOIN ({DRIFT}) USING (frame)", "y x")
TURN = f"SELECT frame, sum(r) OVER (ORDER BY frame) AS rotation FROM (SELECT to_frame AS frame, atan2(sum((b.x - dx - 50) * (b.y - 50) - (b.y - dy - 50) * (b.x - 50)), sum((b.x - dx - 50) * (b.x - 50) + (b.y - dy - 50) * (b.y - 50))) AS r FROM ({STEPS}) JOIN spots b ON b.spot_id = target_id GROUP BY 1)"
q("rotation_drift", lambda v: A.rotation_drift(steps(v), v.spots, (50.0, 50.0)), "spots edges", TURN, "rotation")
q("apply_rotation", lambda v: A.apply_rotation(v.spots, A.rotation_drift(steps(v), v.spots, (50.0, 50.0)), (50.0, 50.0)).select("spot_id", "y", "x"), "spots edges",
  f"SELECT spot_id, sin(-coalesce(rotation, 0)) * (x - 50) + cos(-coalesce(rotation, 0)) * (y - 50) + 50 AS y, cos(-coalesce(rotation, 0)) * (x - 50) - sin(-coalesce(rotation, 0)) * (y - 50) + 50 AS x FROM spots LEFT JOIN ({TURN}) USING (frame)", "y x")
q("crop_common", lambda v: A.crop_common(v.spots, A.xy_drift(steps(v)), (100.0, 200.0)).select("spot_id"), "spots edges",
  f"WITH d AS ({DRIFT}), e AS (SELECT min(drift_y) AS ly, max(drift_y) AS hy, min(drift_x) AS lx, max(drift_x) AS hx FROM d) SELECT spot_id FROM spots, e WHERE y >= round(greatest(0, -ly), 9) AND y <= round(100 - greatest(0, hy), 9) AND x >= round(greatest(0, -lx), 9) AND x <= round(200 - greatest(0, hx), 9)")
ACF = f"""SELECT a.head, lag, sum((a.speed - a.m) * (b.speed - b.m)) / nullif(any_value(a.s), 0) AS acf FROM (SELECT *, avg(speed) OVER (PARTITION BY head) AS m, var_pop(speed) OVER (PARTITION BY head) * n AS s FROM {FULL}) a JOIN range(0, 6) r(lag) ON lag < a.n JOIN (SELECT *, avg(speed) OVER (PARTITION BY head) AS m FROM {FULL}) b ON b.head = a.head AND b.i = a.i + lag GROUP BY 1, 2"""
acf = lambda v: A.autocorrelation(T.numbered(full(v)).select("head", "i", F.col("speed").alias("value")), 5)
q("autocorrelation", lambda v: acf(v).withColumn("lag", F.col("lag").cast("long")), ON, ACF, "acf")
q("pooled_normal_fit", lambda v: A.pooled_normal_fit(full(v).withColumn("later", F.col("generation") > 0), ["later"], "speed"), ON, f'SELECT generation > 0 AS later, avg(speed) AS mean, stddev_pop(speed) AS std FROM {FULL} GROUP BY 1', "mean std")
q("cluster_scatter", lambda v: U.cluster_scatter(v.spots.select("spot_id", "frame", "y", "x", F.col("cell_type").alias("shape"), F.when(F.col("frame") > 5, F.col("cell_type")).alias("dynamic")), ["shape", "dynamic"]), "spots",
  "SELECT frame, y, x, 'shape' AS view, cell_type AS label FROM spots WHERE cell_type IS NOT NULL UNION ALL SELECT frame, y, x, 'dynamic', cell_type FROM spots WHERE cell_type IS NOT NULL AND frame > 5", "y x")
q("labelled_tracklets", lambda v: U.labelled_tracklets(full(v), v.spots.where("spot_id % 5 = 0").select("spot_id", (F.col("spot_id") % 3).alias("label")), ["speed"]), ON,
  f"WITH l AS (SELECT DISTINCT ON (head) head, spot_id % 3 AS label FROM {FULL} WHERE spot_id % 5 = 0 ORDER BY head, frame, spot_id) SELECT spot_id, f.head, speed, label FROM {FULL} f JOIN l ON l.head = f.head", "speed")
OUTER_EDGE = EDGE.replace("a.label > 0 AND b.label = 0", "a.label = 0 AND b.label > 0")
q("boundary_voxels_outer", lambda v: X.boundary_voxels(v.voxels, (2.0, 1.0, 0.5), outer=True), "voxels", OUTER_EDGE, "z y x")
BACK = "SELECT target_id AS source_id, b.frame AS t, b.z AS from_z, b.y AS from_y, b.x AS from_x, a.z AS to_z, a.y AS to_y, a.x AS to_x FROM edges JOIN spots a ON a.spot_id = source_id JOIN spots b ON b.spot_id = target_id WHERE b.frame = a.frame + 1"
q("transitions_reversed", lambda v: A.transitions(v.spots, v.edges, True), "spots edges", BACK, PLACES)
q("fill_transitions_reversed", lambda v: A.fill_transitions(v.spots, v.edges, True), "spots edges",
  f"""SELECT * FROM ({BACK}) UNION ALL SELECT spot_id, frame, z, y, x, tz, ty, tx FROM (SELECT a.spot_id, a.frame, a.z, a.y, a.x, b.z AS tz, b.y AS ty, b.x AS tx, row_number() OVER (PARTITION BY a.spot_id ORDER BY sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), b.spot_id) AS r
  FROM spots a JOIN spots b ON b.frame = a.frame - 1 WHERE a.spot_id NOT IN (SELECT source_id FROM ({BACK}))) WHERE r = 1""", PLACES)  # fmt: skip
BACKWARD = STEP.replace("frame + 1 AS frame", "frame - 1 AS frame")
q("follow_reversed", lambda v: A.follow(v.annotations.select(F.col("ann_id").alias("id"), F.col("t").alias("frame"), "z", "y", "x"), A.transitions(v.spots, v.edges, True), 20.0, 2, reverse=True), "annotations spots edges",
  f"WITH m AS ({BACK}), s0 AS (SELECT ann_id AS id, t AS frame, z, y, x FROM annotations), {', '.join(BACKWARD.format(n=n, p=n - 1) for n in (1, 2))} FROM s0 UNION ALL FROM s1 UNION ALL FROM s2", "z y x")
HOT = ", ".join(f"CASE WHEN s.track_id % 4 = {k} THEN 1.0 ELSE 0.0 END" for k in range(3))
q("patch_labels", lambda v: X.patch_labels(v.spots.select("spot_id", F.col("frame").alias("t"), (F.col("z") / 5).alias("z"), (F.col("y") / 4).alias("y"), (F.col("x") / 8).alias("x"), F.expr("int(track_id % 4)").alias("class_no")), v.voxels, "spot_id", (5, 7, 9), 3).select("spot_id", F.posexplode("label_vector").alias("k", "value")).withColumn("k", F.col("k").cast("long")), "spots voxels",
  f"""SELECT spot_id, unnest(range(0, 10)) AS k, unnest([{HOT}, 4 / 9.0, 3 / 7.0, 2 / 5.0, CASE WHEN y_max - y_min + 1 >= 7 THEN 0.5 ELSE (y_max - y_min + 1) / 7.0 END, CASE WHEN x_max - x_min + 1 >= 9 THEN 0.5 ELSE (x_max - x_min + 1) / 9.0 END, CASE WHEN z_max - z_min + 1 >= 5 THEN 0.5 ELSE (z_max - z_min + 1) / 5.0 END, 1.0]::DOUBLE[]) AS value
  FROM spots s JOIN voxels b ON b.t = s.frame AND b.z = round_even(s.z / 5, 0) AND b.y = round_even(s.y / 4, 0) AND b.x = round_even(s.x / 8, 0) AND b.label > 0 JOIN ({REGIONS}) r ON r.t = b.t AND r.label = b.label WHERE s.track_id % 4 < 3""", "value")  # fmt: skip
