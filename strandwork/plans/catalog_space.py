"""Queries of joins in space and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L
from ..operators import space as P
from .registry import register

D = "sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))"
MATCHED = f"""SELECT DISTINCT ON (det_id) det_id, spot_id, {D} AS distance FROM detections a JOIN spots b ON b.frame = a.t AND {D} <= 5 WHERE score > 0.5 ORDER BY det_id, {D}, spot_id"""
AT = f"""SELECT DISTINCT ON (ann_id) ann_id, a.cell_type, spot_id, track_id FROM annotations a JOIN spots b ON b.frame = a.t AND {D} <= 15 ORDER BY ann_id, {D}, spot_id"""
register("match_detections", lambda v: P.match_detections(v.detections, v.spots), "detections", MATCHED, "distance")
register("filter_score", lambda v: P.filter_score(v.detections).select("det_id", "score"), "detections", "SELECT det_id, score FROM detections WHERE score > 0.5", "score")
register("nearest_within", lambda v: P.nearest_within(v.annotations.withColumnRenamed("t", "frame"), v.spots.select("spot_id", "frame", "z", "y", "x"), 6.0, 2, "ann_id").select(F.col("q_ann_id").alias("ann_id"), F.col("p_spot_id").alias("spot_id"), "gap", "distance"), "annotations",
         f"SELECT DISTINCT ON (ann_id) ann_id, spot_id, abs(a.t - b.frame) AS gap, {D} AS distance FROM annotations a JOIN spots b ON abs(a.t - b.frame) <= 2 AND {D} <= 6 ORDER BY ann_id, abs(a.t - b.frame) + {D}, spot_id", "distance")
register("tracks_at_annotations", lambda v: P.tracks_at_annotations(v.annotations, v.spots), "annotations", f"SELECT ann_id, spot_id, track_id FROM ({AT})")
register("label_from_ground_truth", lambda v: P.label_from_ground_truth(v.annotations, v.spots, v.pieces, 15.0), "annotations pieces",
         f"SELECT p.spot_id, m.cell_type FROM pieces p JOIN (SELECT head, arg_max(m.cell_type, ann_id) AS cell_type FROM ({AT}) m JOIN pieces USING (spot_id) GROUP BY 1) m USING (head)")
register("neighbours_within", lambda v: P.neighbours_within(v.spots, 5.0), "spots", f"SELECT DISTINCT a.spot_id, a.frame, b.track_id FROM spots a JOIN spots b ON a.frame = b.frame AND {D} <= 5")
register("neighbours_within_grid", lambda v: P.neighbours_within(v.spots, 5.0, plan="grid"), "spots", f"SELECT DISTINCT a.spot_id, a.frame, b.track_id FROM spots a JOIN spots b ON a.frame = b.frame AND {D} <= 5")
register("knn", lambda v: P.knn(v.annotations.withColumnRenamed("t", "frame"), v.spots, 3, "ann_id").select(F.col("q_ann_id").alias("ann_id"), F.col("p_spot_id").alias("spot_id"), F.col("rank").cast("long").alias("rank"), "distance"), "annotations",
         f"SELECT ann_id, spot_id, rank, distance FROM (SELECT ann_id, spot_id, {D} AS distance, row_number() OVER (PARTITION BY ann_id ORDER BY {D}, spot_id) AS rank FROM annotations a JOIN spots b ON b.frame = a.t) WHERE rank <= 3", "distance")
REGIONS = "SELECT t, label, avg(z) AS z, avg(y) AS y, avg(x) AS x, count(*) AS size, min(z) AS z_min, max(z) AS z_max, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max, avg(value) AS mean_value, CAST(sum(value) AS BIGINT) AS total FROM voxels WHERE label > 0 GROUP BY 1, 2"


def regions(v):
    from ..operators import voxels

    return voxels.regions(v.voxels)


register("match_second_channel", lambda v: P.match_second_channel(v.spots, regions(v).selectExpr("t", "label", "z", "y", "x", "total", "z_max - z_min + 1 as z_size", "y_max - y_min + 1 as y_size", "x_max - x_min + 1 as x_size"), 12.0), "spots voxels",
         f"""WITH r AS (SELECT *, cbrt(3 * CAST((z_max - z_min + 1) * (y_max - y_min + 1) * (x_max - x_min + 1) AS DOUBLE) / (4 * pi())) AS s FROM ({REGIONS}))
         SELECT * FROM (SELECT DISTINCT ON (spot_id) spot_id, b.label, b.z AS c2_z, b.y AS c2_y, b.x AS c2_x, total AS c2_intensity, s AS c2_radius, {D} AS d FROM spots a JOIN r b ON a.frame = b.t AND {D} <= 12 ORDER BY spot_id, {D}, b.label) WHERE d <= 2 * c2_radius""".replace("SELECT * FROM (SELECT DISTINCT", "SELECT * EXCLUDE (d) FROM (SELECT DISTINCT"), "c2_z c2_y c2_x c2_radius")  # fmt: skip
register("attach_latent", lambda v: P.attach_latent(v.spots, v.annotations.select(F.col("ann_id").alias("latent_id"), F.col("t").alias("frame"), "z", "y", "x", F.array("z", "x").alias("latent")), 8.0).selectExpr("spot_id", "latent[0] as first", "latent[1] as second"), "spots annotations",
         f"SELECT spot_id, lz AS first, lx AS second FROM (SELECT DISTINCT ON (a.spot_id) a.spot_id, a.radius, b.z AS lz, b.x AS lx, {D} AS d FROM spots a JOIN annotations b ON a.frame = b.t AND {D} <= 8 WHERE a.radius > 0 ORDER BY a.spot_id, {D}, b.ann_id) WHERE d < radius", "first second")
register("transfer_positions", lambda v: P.transfer_positions(v.annotations, regions(v)), "annotations voxels",
         f"SELECT ann_id, t, z, y, x FROM (SELECT DISTINCT ON (ann_id) ann_id, b.t, b.z, b.y, b.x FROM annotations a JOIN ({REGIONS}) b ON a.t = b.t AND {D} <= 10 ORDER BY ann_id, {D}, b.label)", "z y x")
register("exact_position_join", lambda v: P.exact_position_join(v.annotations.select("ann_id", F.col("t").alias("frame"), F.col("z") - 1, F.col("y") + 1, "x").toDF("ann_id", "frame", "z", "y", "x"), v.spots).select("ann_id", "spot_id", "track_id"), "annotations",
         "SELECT ann_id, spot_id, track_id FROM annotations a JOIN spots s ON s.frame = a.t AND round(s.z, 6) = round(a.z - 1, 6) AND round(s.y, 6) = round(a.y + 1, 6) AND round(s.x, 6) = round(a.x, 6)")
register("shared_positions", lambda v: P.shared_positions(v.spots.withColumn("x", F.floor(F.col("x") / 20)).withColumn("y", F.floor(F.col("y") / 20)), ("frame", "y", "x")).select("spot_id"), "spots",
         "SELECT spot_id FROM (SELECT spot_id, count(*) OVER (PARTITION BY frame, floor(y / 20), floor(x / 20)) AS n FROM spots) WHERE n > 1")
