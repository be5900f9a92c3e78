"""Readers of tracker output: XML and CSV files as DataFrames, by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attribute names of a spot and what they become.
SPOT = {"ID": ("spot_id", "long"), "FRAME": ("frame", "long"), "POSITION_Z": ("z", "double"), "POSITION_Y": ("y", "double"), "POSITION_X": ("x", "double"), "RADIUS": ("radius", "double"), "QUALITY": ("quality", "double"), "TOTAL_INTENSITY_CH1": ("total_intensity_ch1", "double"), "MEAN_INTENSITY_CH1": ("mean_intensity_ch1", "double"), "TOTAL_INTENSITY_CH2": ("total_intensity_ch2", "double"), "MEAN_INTENSITY_CH2": ("mean_intensity_ch2", "double")}
ENRICHED = {"TRACK_ID": ("track_id", "long"), "unique_id": ("unique_id", "long"), "tracklet_id": ("tracklet_id", "long"), "generation_id": ("generation", "long"), "SPEED": ("speed", "double"), "acceleration": ("acceleration", "double"), "distance_cell_mask": ("distance_cell_mask", "double"), "local_density": ("local_density", "double"), "number_dividing": ("number_dividing", "double"), "motion_angle_z": ("motion_angle_z", "double"), "motion_angle_y": ("motion_angle_y", "double"), "motion_angle_x": ("motion_angle_x", "double"), "radial_angle_z_key": ("radial_angle_z", "double"), "radial_angle_y_key": ("radial_angle_y", "double"), "radial_angle_x_key": ("radial_angle_x", "double"), "cell_axis_z_key": ("cell_axis_z", "double"), "cell_axis_y_key": ("cell_axis_y", "double"), "cell_axis_x_key": ("cell_axis_x", "double"), "msd": ("msd", "double"), "recoil": ("recoil", "double"), "TRACK_DISPLACEMENT": ("track_displacement", "double"), "TOTAL_DISTANCE_TRAVELED": ("total_track_distance", "double"), "MAX_DISTANCE_TRAVELED": ("max_track_distance", "double"), "TRACK_DURATION": ("track_duration", "double"), "cloud_surfacearea": ("surface_area", "double"), "cloud_eccentricity_comp_first": ("eccentricity_first", "double"), "cloud_eccentricity_comp_second": ("eccentricity_second", "double"), "cloud_eccentricity_comp_third": ("eccentricity_third", "double")}
TRACK = {"TRACK_ID": ("track_id", "long"), "TRACK_DISPLACEMENT": ("displacement", "double"), "TOTAL_DISTANCE_TRAVELED": ("total_distance", "double"), "MAX_DISTANCE_TRAVELED": ("max_distance", "double"), "TRACK_DURATION": ("duration", "double")}


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.option("rowTag", tag).schema(schema).xml(path)


def _cast(names: dict[str, tuple[str, str]], prefix: str = "_") -> list[Column]:
    return [F.col(f"{prefix}{k}").try_cast(t).alias(n) for k, (n, t) in names.items()]


def read_spots_xml(spark: SparkSession, path: str, enriched: bool = False) -> DataFrame:
    """One row per spot; attributes that a file does not have are null. Rows without an id (the list elements around them) go."""
    names = SPOT | (ENRICHED if enriched else {})
    return _xml(spark, path, "Spot", ", ".join(f"_{k} string" for k in names)).select(*_cast(names)).where("spot_id is not null")


def read_edges_xml(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, source_id, target_id)."""
    rows = _xml(spark, path, "Track", "_TRACK_ID string, Edge array<struct<_SPOT_SOURCE_ID: string, _SPOT_TARGET_ID: string>>")
    return rows.select(F.col("_TRACK_ID").try_cast("long").alias("track_id"), F.explode("Edge").alias("e")).select("track_id", F.col("e._SPOT_SOURCE_ID").try_cast("long").alias("source_id"), F.col("e._SPOT_TARGET_ID").try_cast("long").alias("target_id"))


def read_tracks_xml(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "Track", ", ".join(f"_{k} string" for k in TRACK)).select(*_cast(TRACK)).where("track_id is not null")


def read_filtered_tracks_xml(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "TrackID", "_TRACK_ID string").select(F.col("_TRACK_ID").try_cast("long").alias("track_id")).where("track_id is not null").distinct()


def read_calibration_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row: pixel sizes, frame interval (0 becomes 1), channel (1 if there is none) and extents. Each part is one row of settings."""
    image = _xml(spark, path, "ImageData", "_pixelwidth string, _pixelheight string, _voxeldepth string, _timeinterval string")
    image = image.agg(*[F.max(F.col(f"_{c}").try_cast("double")).alias(n) for c, n in (("pixelwidth", "x_size"), ("pixelheight", "y_size"), ("voxeldepth", "z_size"), ("timeinterval", "interval"))])
    image = image.withColumn("interval", F.when(F.col("interval") == 0, 1.0).otherwise(F.col("interval")))
    detector = _xml(spark, path, "DetectorSettings", "_TARGET_CHANNEL string").agg(F.coalesce(F.max(F.col("_TARGET_CHANNEL").try_cast("int")), F.lit(1)).alias("channel"))
    names = ("tstart", "tend", "xstart", "xend", "ystart", "yend")
    basic = _xml(spark, path, "BasicSettings", ", ".join(f"_{c} string" for c in names)).agg(*[F.max(F.col(f"_{c}").try_cast("double")).alias(c) for c in names])
    return image.join(detector, F.lit(True)).join(basic, F.lit(True))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_spots_csv(spark: SparkSession, path: str, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Spots of a table with three more header rows (their id is no number); positions (z, y, x) over the pixel sizes, cut to whole numbers."""
    raw = _csv(spark, path)
    names = {k: v for k, v in (SPOT | {"TRACK_ID": ("track_id", "long")}).items() if k in raw.columns}
    rows = raw.select(*_cast(names, "")).where("spot_id is not null")
    return rows.withColumns({c: (F.col(c) / s).cast("int") for c, s in zip(("z", "y", "x"), sizes) if c in rows.columns})


def read_tracks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Track measures as doubles to 3 places, their names in lower case; a measure all in (0, 1] is raised by 1."""
    raw = _csv(spark, path)
    rows = raw.select(*[F.round(F.col(c).try_cast("double"), 3).alias(c.lower()) for c in raw.columns if c != "LABEL"]).where("track_id is not null")
    numbers = [c for c in rows.columns if c != "track_id"]
    ends = rows.agg(*[f(c).alias(f"{c}_{n}") for c in numbers for f, n in ((F.min, "lo"), (F.max, "hi"))])
    raised = rows.join(F.broadcast(ends), F.lit(True))
    return raised.select(F.col("track_id").cast("long").alias("track_id"), *[F.when((F.col(f"{c}_lo") > 0) & (F.col(f"{c}_hi") <= 1), F.col(c) + 1).otherwise(F.col(c)).alias(c) for c in numbers])


def renumber_track_zero(edges: DataFrame) -> DataFrame:
    """Track 0 becomes the largest track and one."""
    top = edges.agg((F.max("track_id") + 1).alias("_top"))
    return edges.join(F.broadcast(top), F.lit(True)).withColumn("track_id", F.when(F.col("track_id") == 0, F.col("_top")).otherwise(F.col("track_id"))).drop("_top")


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    ids = {"TRACK_ID": ("track_id", "long"), "SPOT_SOURCE_ID": ("source_id", "long"), "SPOT_TARGET_ID": ("target_id", "long")}
    more = {c: (c.lower(), "double") for c in raw.columns if c not in ids and c != "LABEL"}
    return renumber_track_zero(raw.select(*_cast(ids | more, "")).where("track_id is not null"))


def read_tracker_csvs(spark: SparkSession, spots: str | None, tracks: str | None, edges: str | None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The three tables, only if all three paths are given."""
    return (read_spots_csv(spark, spots), read_tracks_csv(spark, tracks), read_edges_csv(spark, edges)) if spots and tracks and edges else None


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """(t, z, y, x, score) of event detections."""
    return _csv(spark, path).select(*[F.col(c).try_cast("double").alias(c.lower()) for c in ("T", "Z", "Y", "X", "Score")]).withColumn("t", F.col("t").cast("long"))


def read_annotations(spark: SparkSession, path: str, last_frame: int) -> DataFrame:
    """(t, z, y, x) of annotations with either header: axis-0, -1, -2 are z, y, x of the last frame."""
    raw = _csv(spark, path)
    names = {c.lower(): c for c in raw.columns}
    col = lambda *keys: F.coalesce(*[F.col(f"`{names[k]}`").try_cast("double") for k in keys if k in names], F.lit(None).cast("double"))
    return raw.select(F.coalesce(col("t"), F.lit(float(last_frame))).cast("long").alias("t"), col("z", "axis-0").alias("z"), col("y", "axis-1").alias("y"), col("x", "axis-2").alias("x"))


def read_ground_truth(spark: SparkSession, path: str, label: str, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(t, z, y, x, label) of labelled places over the pixel sizes; rows without a label go."""
    raw = _csv(spark, path).dropna(subset=[label])
    return raw.select(F.col("FRAME").try_cast("long").alias("t"), *[(F.col(f"POSITION_{c.upper()}").try_cast("double") / s).alias(c) for c, s in zip(("z", "y", "x"), sizes)], F.col(label).alias("label"))


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """Label images as a Parquet table (t, z, y, x, value, label)."""
    return spark.read.parquet(path).select("t", "z", "y", "x", "value", "label")
