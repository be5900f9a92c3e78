"""The tables that analyses start from: all spots with all their features, and tracklets ready for clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DYNAMIC, SHAPE, STATUS, drop_invalid_rows, tracklet_key, usable_radius, view_columns
from .kinematics import POSITION, root_displacement
from .lineage import division_label
from .summary import class_balanced_sample, region_of_interest
from .tracklets import centre_row, raw_vector

#: Columns that name a row of the feature table, and that come after its features.
IDENTITY, MAPPED = ("tracklet", "t", "z", "y", "x"), ("track_id", "generation", "tracklet_no", "track_duration")
#: Measures of a whole track as track_summary() names them, and as the track table does.
TRACK = {"displacement": "track_displacement", "total_distance": "total_track_distance", "max_distance": "max_track_distance", "duration": "track_duration"}
#: What regions bring to their nearest spot.
REGION = ("eccentricity_first", "eccentricity_second", "eccentricity_third", "surface_area", "cell_axis_z", "cell_axis_y", "cell_axis_x")


def properties(spots: DataFrame, edges: DataFrame, pieces: DataFrame, motion: DataFrame, shapes: DataFrame | None = None, boundary: DataFrame | None = None, density: DataFrame | None = None) -> DataFrame:
    """One row per spot with everything that is known of it.

    spots (spot_id, track_id, frame, z, y, x, radius, intensity) with pieces' generation, head and tracklet_no, motion's
    speed, acceleration and angles, displacement from the root (msd, recoil), and where given: shapes (spot_id,
    region_radius, REGION), boundary (spot_id, distance_cell_mask), density (spot_id, local_density). A spot with a
    region and a radius above 0 takes the region's; where its own is 0 or less only the axis angles count. What is missing is null.
    """
    df = spots.select("spot_id", "track_id", "frame", *POSITION, usable_radius(F.col("radius")).alias("radius"), F.col("intensity").alias("total_intensity"))
    df = df.join(pieces.select("spot_id", "head", "generation", "tracklet_no"), "spot_id").join(motion.drop("track_id", "frame"), "spot_id").join(root_displacement(spots, edges), "spot_id")
    if shapes is None:
        df = df.withColumns({c: F.lit(None).cast("double") for c in REGION})
    else:
        df = df.join(shapes.select("spot_id", "region_radius", *REGION), "spot_id", "left")
        own = F.col("radius").isNotNull()
        df = df.withColumns({c: F.when(own, F.col(c)) for c in REGION if not c.startswith("cell_axis")}).withColumn("radius", F.when(own, F.coalesce("region_radius", "radius"))).drop("region_radius")
    for other, column, kind in ((boundary, "distance_cell_mask", "double"), (density, "local_density", "long")):
        df = df.withColumn(column, F.lit(None).cast(kind)) if other is None else df.join(other.select("spot_id", column), "spot_id", "left")
    return df


def track_table(known: DataFrame, summary: DataFrame, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The 31-column table of all spots: properties() with its track's measures; positions over the pixel sizes (z, y, x).

    unique_id is the track, generation and tracklet number written one after the other.
    """
    df = known.join(summary.select("track_id", *TRACK), "track_id")
    names = {"gen_id": "generation", "eccentricity_comp_first": "eccentricity_first", "eccentricity_comp_second": "eccentricity_second", "eccentricity_comp_third": "eccentricity_third", "local_cell_density": "local_density"}
    order = ("gen_id", "radius", "eccentricity_comp_first", "eccentricity_comp_second", "eccentricity_comp_third", "surface_area", "total_intensity", "speed", "motion_angle_z", "motion_angle_y", "motion_angle_x", "acceleration", "distance_cell_mask", "local_cell_density", "radial_angle_z", "radial_angle_y", "radial_angle_x", "cell_axis_z", "cell_axis_y", "cell_axis_x")
    unique = tracklet_key(F.col("track_id"), F.col("generation"), F.col("tracklet_no")).alias("unique_id")
    place = [(F.col(c) / s).alias(c) for c, s in zip(POSITION, sizes)]
    return df.select(unique, F.col("frame").alias("t"), *place, *[F.col(names.get(c, c)).alias(c) for c in order], *[F.col(c).cast("double").alias(n) for c, n in TRACK.items()], "msd", "recoil")


def feature_view(table: DataFrame) -> DataFrame:
    """The 27 named features of the track table: all but a row's tracklet and place, with its time first."""
    renamed = table.withColumnsRenamed({"t": "time", "gen_id": "generation"})
    return renamed.select("time", *[c for c in renamed.columns if c not in ("unique_id", "time", *POSITION)])


def feature_table(known: DataFrame, spots: DataFrame, edges: DataFrame, summary: DataFrame, latent: DataFrame | None = None) -> DataFrame:
    """The 26 features of every spot, then its track, generation, tracklet number and the track's duration; with latent (spot_id, latent) that array too.

    Rows are not sorted: a consumer sorts within its tracklets, and a sort of all rows would say nothing to Spark.
    """
    df = known.join(division_label(spots, edges), "track_id").join(summary.select("track_id", F.col("duration").cast("double").alias("track_duration")), "track_id")
    df = df.withColumnsRenamed({"frame": "t", "head": "tracklet"})
    if latent is not None:
        df = df.join(latent.select("spot_id", "latent"), "spot_id", "left")
    return df.select("spot_id", *IDENTITY, *STATUS, *SHAPE, *DYNAMIC, *MAPPED, *(["latent"] if latent is not None else []))


def analysis_tracklets(features: DataFrame, view: str = "shape_dynamic", window: tuple[float, float] | None = None, class_ratio: float = -1, ignore: Sequence[str] = (), label: str | None = None, seed: int = 0) -> DataFrame:
    """Rows of the feature table for clustering: spot_id, identity, the features of a view and, if asked, the label.

    Only times within the window (inclusive); with a class_ratio above 0 at most that many non-dividing tracklets per
    dividing one; rows with a null or NaN feature of the view, or a null label, are dropped.
    """
    rows = features if window is None else region_of_interest(features, t=window)
    if class_ratio > 0:
        tracklets = rows.groupBy("tracklet").agg(F.max("dividing").alias("dividing"))
        rows = rows.join(class_balanced_sample(tracklets, "dividing", class_ratio, seed, "tracklet").select("tracklet"), "tracklet", "left_semi")
    if label is not None:
        rows = rows.where(F.col(label).isNotNull())
    columns = view_columns(view, ignore)
    numbers = [c for c in columns if c != "dividing"]
    return drop_invalid_rows(rows, numbers).select("spot_id", *IDENTITY, *columns, *([label] if label is not None else []))


def tracklet_vectors(rows: DataFrame, length: int, views: Sequence[str] = ("shape", "dynamic", "shape_dynamic"), ignore: Sequence[str] = ()) -> DataFrame:
    """(tracklet, a flat vector per view, t, z, y, x) of feature rows: their first `length` rows or the last one repeated, and the place of the middle one."""
    at = rows.withColumn("frame", F.col("t"))
    out = centre_row(at, length, "tracklet").select(*IDENTITY)
    for view in views:
        out = out.join(raw_vector(at, view_columns(view, ignore), length, "tracklet").withColumnRenamed("vector", view), "tracklet")
    return out
