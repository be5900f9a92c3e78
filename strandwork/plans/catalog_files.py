"""Queries of readers and writers: what Spark writes in a format is read again and set against its source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources import sinks as O
from ..sources import tracker as R
from .catalog_lineage import SUMMARY
from .registry import register


def scratch(v, name: str) -> str:
    return f"{shared_folder(v.spark)}/strandwork/{name}-{uuid.uuid4().hex}"


def as_xml(rows, path: str, tag: str):
    rows.select(*[F.col(c).alias(c if t.startswith("array") else f"_{c}") for c, t in rows.dtypes]).write.format("xml").option("rootTag", "Model").option("rowTag", tag).save(path)
    return path


def as_csv(rows, path: str) -> str:
    rows.write.option("header", True).csv(path)
    return path


def named(rows, names):
    """Columns by the attribute names of a file."""
    return rows.select(*[F.col(c).alias(k) for k, (c, _) in names.items() if c in rows.columns])


def spots_xml(v):
    path = scratch(v, "xml")
    O.write_enriched_spots(named(v.spots, R.SPOT), path, "xml")
    return R.read_spots_xml(v.spark, path).select("spot_id", "frame", "z", "y", "x", "radius")


register("read_spots_xml", spots_xml, "spots", "SELECT spot_id, frame, z, y, x, radius FROM spots", "z y x radius")


def enriched_xml(v):
    path = scratch(v, "xml")
    rows = v.known.withColumn("local_density", F.col("local_density").cast("double")).withColumn("number_dividing", F.lit(None).cast("double"))
    O.write_enriched_spots(named(rows, R.SPOT | R.ENRICHED), path, "xml")
    kept = [c for c in v.known.columns if c in {n for n, _ in (R.SPOT | R.ENRICHED).values()}]
    return R.read_spots_xml(v.spark, path, True).select(*kept)


ENRICHED = [n for n, _ in R.ENRICHED.values()]
KEPT = ["spot_id", "frame", "z", "y", "x", "radius", *[c for c in ENRICHED if c in ("track_id", "generation", "speed", "acceleration", "distance_cell_mask", "local_density", "surface_area", "msd", "recoil") or c.startswith(("motion", "radial", "cell_axis", "eccentricity"))]]
register("read_enriched_spots_xml", enriched_xml, "known", f"SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' if c == 'local_density' else c for c in KEPT)} FROM known", " ".join(c for c in KEPT if c not in ("spot_id", "frame", "track_id", "generation")))


def edges_xml(v):
    edge = F.struct(F.col("source_id").alias("_SPOT_SOURCE_ID"), F.col("target_id").alias("_SPOT_TARGET_ID"))
    tracks = v.edges.groupBy(F.col("track_id").alias("TRACK_ID")).agg(F.collect_list(edge).alias("Edge"))
    return R.read_edges_xml(v.spark, as_xml(tracks, scratch(v, "edges"), "Track"))


register("read_edges_xml", edges_xml, "edges", "SELECT track_id, source_id, target_id FROM edges")


def summary(v):
    from ..operators import kinematics

    return kinematics.track_summary(v.spots, v.edges)


MEASURES = "displacement total_distance max_distance duration"
register("read_tracks_xml", lambda v: R.read_tracks_xml(v.spark, as_xml(named(summary(v), R.TRACK), scratch(v, "tracks"), "Track")), "spots edges", f"SELECT track_id, displacement, total_distance, max_distance, duration FROM ({SUMMARY})", MEASURES)
register("read_filtered_tracks_xml", lambda v: R.read_filtered_tracks_xml(v.spark, as_xml(v.annotations.join(v.spots, F.col("ann_id") == F.col("spot_id")).select(F.col("track_id").alias("TRACK_ID")), scratch(v, "listed"), "TrackID")), "annotations spots",
         "SELECT DISTINCT track_id FROM annotations JOIN spots ON ann_id = spot_id")


def calibration(v):
    """Settings made from the extents of the voxels, each element in a file of one folder."""
    folder, ends = scratch(v, "settings"), v.voxels.agg(*[F.max(c).alias(c) for c in ("t", "z", "y", "x")])
    image = ends.select((F.col("x") / 64).alias("pixelwidth"), (F.col("y") / 64).alias("pixelheight"), (F.col("z") / 2).alias("voxeldepth"), F.lit(0.0).alias("timeinterval"))
    basic = ends.select(F.lit(0).alias("tstart"), F.col("t").alias("tend"), F.lit(0).alias("xstart"), F.col("x").alias("xend"), F.lit(0).alias("ystart"), F.col("y").alias("yend"))
    as_xml(image, f"{folder}/kind=a", "ImageData")
    as_xml(basic, f"{folder}/kind=b", "BasicSettings")
    return R.read_calibration_xml(v.spark, f"{folder}/*")


register("read_calibration_xml", calibration, "voxels",
         "SELECT max(x) / CAST(64 AS DOUBLE) AS x_size, max(y) / CAST(64 AS DOUBLE) AS y_size, max(z) / CAST(2 AS DOUBLE) AS z_size, CAST(1 AS DOUBLE) AS interval, 1 AS channel, CAST(0 AS DOUBLE) AS tstart, CAST(max(t) AS DOUBLE) AS tend, CAST(0 AS DOUBLE) AS xstart, CAST(max(x) AS DOUBLE) AS xend, CAST(0 AS DOUBLE) AS ystart, CAST(max(y) AS DOUBLE) AS yend FROM voxels",
         "x_size y_size z_size interval tstart tend xstart xend ystart yend")


def spots_csv(v) -> str:
    """The spots' table with three more header rows."""
    rows = named(v.spots, R.SPOT | {"TRACK_ID": ("track_id", "long")})
    rows = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    heads = v.spark.createDataFrame([tuple(f"{c} {i}" for c in rows.columns) for i in range(3)], rows.schema)
    return as_csv(heads.union(rows), scratch(v, "spots"))


def tracks_csv(v) -> str:
    rows = summary(v)
    return as_csv(rows.select(F.lit("x").alias("LABEL"), F.col("track_id").alias("TRACK_ID"), F.col("number_spots").alias("NUMBER_SPOTS"), F.col("max_speed").alias("TRACK_MAX_SPEED"), F.col("linearity").alias("LINEARITY_OF_FORWARD_PROGRESSION")), scratch(v, "tracks"))


def edges_csv(v) -> str:
    return as_csv(v.edges.select(F.lit("x").alias("LABEL"), F.col("track_id").alias("TRACK_ID"), F.col("source_id").alias("SPOT_SOURCE_ID"), F.col("target_id").alias("SPOT_TARGET_ID"), ((F.col("source_id") + F.col("target_id")) / 2).alias("SPEED")), scratch(v, "edges"))


SPOTS = "SELECT spot_id, frame, CAST(trunc(z / 2) AS INTEGER) AS z, CAST(trunc(y / 0.5) AS INTEGER) AS y, CAST(trunc(x / 0.25) AS INTEGER) AS x, radius, track_id FROM spots"
register("read_spots_csv", lambda v: R.read_spots_csv(v.spark, spots_csv(v), (2.0, 0.5, 0.25)), "spots", SPOTS, "radius")
TRACKS = f"""WITH s AS (SELECT track_id, round(CAST(number_spots AS DOUBLE), 3) AS number_spots, round(max_speed, 3) AS track_max_speed, round(linearity, 3) AS linearity_of_forward_progression FROM ({SUMMARY}))
 SELECT track_id, {", ".join(f"CASE WHEN min({c}) OVER () > 0 AND max({c}) OVER () <= 1 THEN {c} + 1 ELSE {c} END AS {c}" for c in ("number_spots", "track_max_speed", "linearity_of_forward_progression"))} FROM s"""
register("read_tracks_csv", lambda v: R.read_tracks_csv(v.spark, tracks_csv(v)), "spots edges", TRACKS, "number_spots track_max_speed linearity_of_forward_progression")
EDGES = "SELECT CASE WHEN track_id = 0 THEN (SELECT max(track_id) + 1 FROM edges) ELSE track_id END AS track_id, source_id, target_id, (source_id + target_id) / 2 AS speed FROM edges"
register("read_edges_csv", lambda v: R.read_edges_csv(v.spark, edges_csv(v)), "edges", EDGES, "speed")


def three(v):
    """The three tables at once, as counts by track."""
    spots, tracks, edges = R.read_tracker_csvs(v.spark, spots_csv(v), tracks_csv(v), edges_csv(v))
    counted = lambda df, name: df.groupBy("track_id").agg(F.count("*").alias(name))
    return counted(spots, "spots").join(counted(edges, "edges"), "track_id", "left").join(tracks.select("track_id", "number_spots"), "track_id", "left")


register("read_tracker_csvs", three, "spots edges",
         f"SELECT track_id, s.n AS spots, e.n AS edges, CAST(s.n AS DOUBLE) AS number_spots FROM (SELECT track_id, count(*) AS n FROM spots GROUP BY 1) s LEFT JOIN (SELECT track_id, count(*) AS n FROM ({EDGES}) GROUP BY 1) e USING (track_id)", "number_spots")
register("read_detections", lambda v: R.read_detections(v.spark, as_csv(v.detections.select(*[F.col(c.lower()).alias(c) for c in ("T", "Z", "Y", "X", "Score")]), scratch(v, "events"))), "detections", "SELECT t, z, y, x, score FROM detections", "z y x score")
register("read_annotations", lambda v: R.read_annotations(v.spark, as_csv(v.annotations.select(F.col("t").alias("T"), F.col("z").alias("Z"), "y", "x"), scratch(v, "points")), 9).unionByName(R.read_annotations(v.spark, as_csv(v.annotations.select(F.col("z").alias("axis-0"), F.col("y").alias("axis-1"), F.col("x").alias("axis-2")), scratch(v, "points")), 9)), "annotations",
         "SELECT t, z, y, x FROM annotations UNION ALL SELECT 9, z, y, x FROM annotations", "z y x")
register("read_ground_truth", lambda v: R.read_ground_truth(v.spark, as_csv(v.spots.select(F.col("frame").alias("FRAME"), *[F.col(c).alias(f"POSITION_{c.upper()}") for c in "zyx"], F.col("cell_type").alias("Kind")), scratch(v, "truth")), "Kind", (2.0, 1.0, 0.5)), "spots",
         "SELECT frame AS t, z / 2 AS z, y, x / 0.5 AS x, cell_type AS label FROM spots WHERE cell_type IS NOT NULL", "z y x")


def voxels_file(v):
    path = scratch(v, "voxels")
    v.voxels.withColumn("more", F.lit(1)).write.parquet(path)
    return R.read_voxels(v.spark, path)


register("read_voxels", voxels_file, "voxels", "SELECT t, z, y, x, value, label FROM voxels")


def written(v, write, read, name: str):
    path = scratch(v, name)
    write(path)
    return read(path)


register("write_enriched_spots", lambda v: written(v, lambda p: O.write_enriched_spots(v.spots.select("spot_id", "x", "cell_type"), p), v.spark.read.parquet, "enriched"), "spots", "SELECT spot_id, x, cell_type FROM spots", "x")
register("write_class_tables", lambda v: written(v, lambda p: O.write_class_tables(v.spots.select("spot_id", "x", "cell_type"), p, "cell_type"), v.spark.read.option("header", True).schema("spot_id long, x double, cell_type string").csv, "classes"), "spots", "SELECT spot_id, x, cell_type FROM spots", "x")
register("write_feature_slices", lambda v: written(v, lambda p: O.write_feature_slices(v.spots, "cell_type", ["x", "intensity"], p), v.spark.read.parquet, "slices").select("spot_id", F.col("cohort").cast("string").alias("cohort"), F.col("feature").cast("string").alias("feature"), "value"), "spots",
         "SELECT spot_id, cell_type AS cohort, unnest(['x', 'intensity']) AS feature, unnest([x, intensity]) AS value FROM spots", "value")
register("write_loops", lambda v: written(v, lambda p: O.write_loops(v.spots.select(F.col("frame").alias("t"), F.col("z").alias("birth"), (F.col("z") + F.col("y")).alias("death")), p), v.spark.read.option("header", True).schema("birth double, death double, persistence double, t long").csv, "loops"), "spots",
         "SELECT frame AS t, z AS birth, z + y AS death, z + y - z AS persistence FROM spots", "birth death persistence")
register("write_cluster_points", lambda v: written(v, lambda p: O.write_cluster_points(v.spots, p, "cell_type"), v.spark.read.option("header", True).schema("t long, y double, x double, cluster string").csv, "points"), "spots", "SELECT frame AS t, y, x, cell_type AS cluster FROM spots", "y x")
c2 = lambda v: v.annotations.select(F.col("ann_id").alias("spot_id"), F.col("z").alias("c2_z"), F.col("y").alias("c2_y"), F.col("x").alias("c2_x"), F.lit(7).alias("c2_intensity"))
register("write_channel_spots", lambda v: written(v, lambda p: O.write_channel_spots(v.spots.select("spot_id", "track_id", "frame", "z", "y", "x", "intensity"), c2(v), p), v.spark.read.parquet, "channel"), "spots annotations",
         "SELECT spot_id, track_id, frame, coalesce(a.z, s.z) AS z, coalesce(a.y, s.y) AS y, coalesce(a.x, s.x) AS x, CASE WHEN ann_id IS NULL THEN intensity ELSE 7 END AS intensity FROM spots s LEFT JOIN annotations a ON ann_id = spot_id", "z y x intensity")
