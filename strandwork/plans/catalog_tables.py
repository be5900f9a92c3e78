"""Queries of the tables that analyses start from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import DYNAMIC, SHAPE, view_columns
from ..operators import analysis as A
from ..operators import kinematics as K
from ..operators import lineage as L
from ..operators import space as P
from ..operators import summary as U
from ..operators import tables as B
from ..operators import voxels as X
from .catalog_lineage import SUMMARY
from .registry import MOMENTS as MOMENTS_SQL
from .registry import register

NUMBERS = [c for c in (*SHAPE, *DYNAMIC) if c != "local_density"]
summary = lambda v: K.track_summary(v.spots, v.edges)
features = lambda v: B.feature_table(v.known, v.spots, v.edges, summary(v))
DIVIDING = "(SELECT track_id, count(source_id) AS number_dividing, count(source_id) > 0 AS dividing FROM (SELECT DISTINCT track_id FROM spots) LEFT JOIN (SELECT track_id, source_id FROM edges GROUP BY ALL HAVING count(*) > 1) USING (track_id) GROUP BY 1)"
FEATURES = f"""SELECT k.spot_id, k.head AS tracklet, k.frame AS t, k.z, k.y, k.x, d.dividing, d.number_dividing, {", ".join(f"k.{c}" for c in (*SHAPE, *DYNAMIC))}, k.track_id, k.generation, k.tracklet_no, u.duration AS track_duration
 FROM known k JOIN {DIVIDING} d USING (track_id) JOIN ({SUMMARY}) u USING (track_id)"""
register("feature_table", features, "known", FEATURES, " ".join(["z y x track_duration", *NUMBERS]))
register("feature_table_latent", lambda v: B.feature_table(v.known, v.spots, v.edges, summary(v), v.annotations.select(F.col("ann_id").alias("spot_id"), F.array("z", "x").alias("latent"))).select("spot_id", "t", F.get("latent", F.lit(0)).alias("first"), F.get("latent", F.lit(1)).alias("second")), "known annotations",
         "SELECT k.spot_id, k.frame AS t, a.z AS first, a.x AS second FROM known k LEFT JOIN annotations a ON a.ann_id = k.spot_id", "first second")

TRACK = f"""SELECT CAST(concat(k.track_id, generation, tracklet_no) AS BIGINT) AS unique_id, k.frame AS t, k.z / 2 AS z, k.y / 0.5 AS y, k.x / 0.25 AS x, generation AS gen_id, radius, eccentricity_first AS eccentricity_comp_first, eccentricity_second AS eccentricity_comp_second, eccentricity_third AS eccentricity_comp_third,
 surface_area, total_intensity, speed, motion_angle_z, motion_angle_y, motion_angle_x, acceleration, distance_cell_mask, local_density AS local_cell_density, radial_angle_z, radial_angle_y, radial_angle_x, cell_axis_z, cell_axis_y, cell_axis_x,
 CAST(u.displacement AS DOUBLE) AS track_displacement, CAST(u.total_distance AS DOUBLE) AS total_track_distance, CAST(u.max_distance AS DOUBLE) AS max_track_distance, CAST(u.duration AS DOUBLE) AS track_duration, msd, recoil FROM known k JOIN ({SUMMARY}) u USING (track_id)"""
MEASURED = "radius eccentricity_comp_first eccentricity_comp_second eccentricity_comp_third surface_area total_intensity speed motion_angle_z motion_angle_y motion_angle_x acceleration distance_cell_mask radial_angle_z radial_angle_y radial_angle_x cell_axis_z cell_axis_y cell_axis_x track_displacement total_track_distance max_track_distance track_duration msd recoil"
tracks = lambda v: B.track_table(v.known, summary(v), (2.0, 0.5, 0.25))
register("track_table", tracks, "known", TRACK, f"z y x {MEASURED}")
register("feature_view", lambda v: B.feature_view(tracks(v)), "known", f"SELECT t AS time, gen_id AS generation, * EXCLUDE (t, gen_id, unique_id, z, y, x) FROM ({TRACK})", MEASURED)

usual = [c for c in view_columns("shape_dynamic", B.REGION)]
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in usual)
register("analysis_tracklets", lambda v: B.analysis_tracklets(features(v), "shape_dynamic", (2, 30), ignore=B.REGION), "known",
         f"SELECT spot_id, tracklet, t, z, y, x, {', '.join(usual)} FROM ({FEATURES}) WHERE t BETWEEN 2 AND 30 AND {COMPLETE}", " ".join(["z y x", *[c for c in usual if c != "local_density"]]))
register("analysis_tracklets_regions", lambda v: B.analysis_tracklets(features(v), "full"), "known",
         f"SELECT * EXCLUDE (track_id, generation, tracklet_no, track_duration) FROM ({FEATURES}) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*SHAPE, *DYNAMIC))}", " ".join(["z y x", *NUMBERS]))
register("analysis_tracklets_by_type", lambda v: B.analysis_tracklets(features(v).join(v.spots.select("spot_id", "cell_type"), "spot_id"), "dynamic", ignore=B.REGION, label="cell_type"), "known",
         f"SELECT f.spot_id, tracklet, t, f.z, f.y, f.x, {', '.join(c for c in usual if c in DYNAMIC)}, cell_type FROM ({FEATURES}) f JOIN spots s ON s.spot_id = f.spot_id WHERE cell_type IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in usual if c in DYNAMIC)}",
         " ".join(["z y x", *[c for c in usual if c in DYNAMIC]]))
#: The sample is by a hash that SQL has not; it is held against plain Python in the tests.
register("analysis_tracklets_balanced", lambda v: B.analysis_tracklets(features(v), "dynamic", class_ratio=0.5, ignore=B.REGION).select("spot_id", "tracklet", "t"))

register("select_features_of_view", lambda v: U.select_features(features(v).withColumn("latent_0", F.col("msd") * 2), "dynamic", B.REGION, ("spot_id", "t"), "dividing"), "known",
         f"SELECT spot_id, t, {', '.join(c for c in usual if c in DYNAMIC)}, msd * 2 AS latent_0, dividing FROM ({FEATURES}) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in usual if c in DYNAMIC)} AND msd IS NOT NULL",
         " ".join(["latent_0", *[c for c in usual if c in DYNAMIC]]))
SHORT = [c for c in usual if c not in ("radius",)]
NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY tracklet ORDER BY t, spot_id) - 1 AS i, count(*) OVER (PARTITION BY tracklet) AS n FROM ({FEATURES}))"
register("tracklet_vectors", lambda v: B.tracklet_vectors(features(v), 4, ("shape_dynamic",), ("radius", *B.REGION)).select("tracklet", "t", "z", "y", "x", F.posexplode("shape_dynamic").alias("place", "value")), "known",
         f"""WITH r AS (SELECT a.tracklet, k, c.t, c.z, c.y, c.x, unnest(range(0, {len(SHORT)})) AS j, unnest([{', '.join(f'CAST(a.{c} AS DOUBLE)' for c in SHORT)}]) AS value FROM {NUMBERED} a JOIN range(0, 4) g(k) ON a.i = least(k, a.n - 1) JOIN {NUMBERED} c ON c.tracklet = a.tracklet AND c.i = least(2, c.n - 1))
         SELECT tracklet, t, z, y, x, CAST(k * {len(SHORT)} + j AS INTEGER) AS place, value FROM r""", "z y x value")  # fmt: skip

M = [*[f"change_{c}" for c in "zyx"], *U.MEASURES]
register("frame_summary", lambda v: U.frame_summary(v.known.join(v.spots.select("spot_id", "cell_type"), "spot_id").join(L.division_label(v.spots, v.edges).select("track_id", "dividing"), "track_id"), U.cohorts(F.col("dividing"), F.col("cell_type"))), "known",
         f"""WITH t AS (SELECT k.*, unnest(['all', CASE WHEN dividing THEN 'dividing' ELSE 'non_dividing' END, cell_type]) AS cohort FROM known k JOIN {DIVIDING} d USING (track_id) JOIN (SELECT spot_id, cell_type FROM spots) s ON s.spot_id = k.spot_id),
         c AS (SELECT *, {", ".join(f"abs({a} - lag({a}) OVER (PARTITION BY frame, cohort ORDER BY spot_id)) AS change_{a}" for a in "zyx")} FROM t WHERE cohort IS NOT NULL)
         SELECT frame, cohort, count(*) AS n, {", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in M)} FROM c GROUP BY 1, 2""", " ".join(f"{m}_mean {m}_std" for m in M))  # fmt: skip
register("descendants_of", lambda v: L.descendants_of(v.edges, L.roots(v.edges)), "edges",
         """SELECT * FROM (WITH RECURSIVE a AS (SELECT source_id AS spot_id, target_id AS descendant FROM edges WHERE source_id NOT IN (SELECT target_id FROM edges)
         UNION ALL SELECT a.spot_id, e.target_id FROM a JOIN edges e ON e.source_id = a.descendant) SELECT DISTINCT * FROM a)""")  # fmt: skip
register("track_clouds", lambda v: A.track_clouds(v.pred_spots), "pred_spots", "SELECT track_id, count(*) OVER (PARTITION BY track_id) AS n, frame, z, y, x FROM pred_spots", "z y x")
register("downsample_time", lambda v: A.downsample_time(v.pred_spots, 3).select("spot_id", "frame"), "pred_spots", "SELECT spot_id, frame * 3 AS frame FROM pred_spots")
MOMENTS = "eccentricity_first eccentricity_second eccentricity_third eigen_first eigen_second eigen_third cell_axis_z cell_axis_y cell_axis_x"
register("shape_moments", lambda v: X.shape_moments(v.voxels), "shapes", MOMENTS_SQL, MOMENTS)
register("region_shapes", lambda v: X.region_shapes(v.voxels), "shapes", "SELECT * FROM shapes", f"z y x {MOMENTS} area")
AROUND = "region_radius eccentricity_first eccentricity_second eccentricity_third surface_area cell_axis_z cell_axis_y cell_axis_x"
register("attach_regions", lambda v: v.shapes, "around", "SELECT * FROM around", AROUND)
register("distance_to_boundary", lambda v: P.distance_to_boundary(v.spots, v.edge_of_mask), "mask", "SELECT * FROM mask", "distance_cell_mask mask_centroid_z mask_centroid_y mask_centroid_x")
register("label_density", lambda v: P.label_density(v.spots, v.voxels, 2.0), "density", "SELECT * FROM density")
