"""Column builders: angles, scales, sentinels, time steps and names. All are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Features of a spot by kind, as the feature table names them.
SHAPE = ("radius", "eccentricity_first", "eccentricity_second", "eccentricity_third", "local_density", "surface_area")
DYNAMIC = ("speed", "motion_angle_z", "motion_angle_y", "motion_angle_x", "acceleration", "distance_cell_mask", "radial_angle_z", "radial_angle_y", "radial_angle_x", "cell_axis_z", "cell_axis_y", "cell_axis_x", "msd")
STATUS = ("dividing", "number_dividing")


def view_columns(view: str, ignore: Sequence[str] = ()) -> list[str]:
    """Features of a view: shape, dynamic, shape_dynamic or full (status and msd too), less the ignored ones."""
    dynamic = [c for c in DYNAMIC if c != "msd"]
    views = {"shape": [*SHAPE], "dynamic": dynamic, "shape_dynamic": [*SHAPE, *dynamic], "full": [*STATUS, *SHAPE, *DYNAMIC]}
    return [c for c in views[view] if c not in ignore]


def axis_angle(z: Column, y: Column, x: Column, axis: str) -> Column:
    """Degrees between a vector and an axis; null for a vector of length 0."""
    part = {"z": z, "y": y, "x": x}[axis]
    norm = F.sqrt(z * z + y * y + x * x)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), part / F.nullif(norm, F.lit(0.0))))))


def saturating(x: Column) -> Column:
    """1 - e^-x."""
    return 1 - F.exp(-x)


def rescale(x: Column, scale: float) -> Column:
    return x * scale


def to_pixels(position: Column, size: float, mode: str = "divide") -> Column:
    """Position over the pixel size: as it is (divide), rounded half to even first (round), or cut to an int (truncate)."""
    if mode == "round":
        return F.bround(position, 0) / size
    return (position / size).cast("int") if mode == "truncate" else position / size


def null_sentinel(x: Column, sentinel: float = -1) -> Column:
    return F.nullif(x, F.lit(sentinel).cast("double"))


def with_sentinel(x: Column, sentinel: float = -1) -> Column:
    return F.coalesce(x, F.lit(sentinel).cast("double"))


def usable_radius(x: Column) -> Column:
    """Null where the radius is 0 or less: such radii are missing in summaries."""
    return F.when(x > 0, x)


def pick_channel(channel: int, ch1: Column, ch2: Column) -> Column:
    """Channel 1 (from 0) reads the second channel's value, others the first's; -1 where it is missing."""
    return F.coalesce(ch2 if channel == 1 else ch1, F.lit(-1.0))


def minmax_scale(x: Column, low: Column, high: Column, eps: float = 1e-20) -> Column:
    return (x - low) / (high - low + eps)


def numbers_in(name: Column) -> Column:
    """All whole numbers in a name."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), lambda s: s.cast("long"))


def number_or(name: Column, pattern: str, default: int = -1) -> Column:
    return F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(default).cast("long"))


def division_count_in(name: Column) -> Column:
    return number_or(name, r"Dividing_(\d+)")


def cell_type_in(name: Column) -> Column:
    found = F.regexp_extract(name, r"Cell_Type_([A-Za-z]+)", 1)
    return F.when(found == "", F.lit("-1")).otherwise(found)


def arrange_scale(dims: Column, scale: dict[str, float]) -> Column:
    """Scale per axis in the order of an axis string such as TZYX."""
    value = F.create_map(*[x for k, v in scale.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.transform(F.filter(F.split(dims, ""), lambda d: d != ""), lambda d: F.element_at(value, d))


def tracklet_key(track: Column, generation: Column, number: Column) -> Column:
    """Track, generation and tracklet number written one after the other, as a number."""
    return F.concat(track.cast("string"), generation.cast("string"), number.cast("string")).try_cast("long")


def histogram_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin (from 0) of equal width; the largest value is in the last bin; null for null or a single value's range (then bin 0)."""
    width = F.nullif(high - low, F.lit(0.0))
    return F.when(x.isNotNull(), F.least(F.lit(bins - 1), F.coalesce(F.floor((x - low) / width * bins), F.lit(0)))).cast("long")


def add_noise(df: DataFrame, columns: Sequence[str], sigma: float, seed: int = 0) -> DataFrame:
    """Gaussian noise on columns; none at sigma 0."""
    return df.withColumns({c: F.col(c) + F.randn(seed + i) * sigma for i, c in enumerate(columns)}) if sigma else df


def drop_invalid_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with neither null nor NaN in columns."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def zscore(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """column_z: over the group's mean and population deviation; null where the deviation is 0. One small aggregate joined back."""
    if by:
        stats = df.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
        joined = df.join(stats, list(by))
    else:
        joined = df.join(F.broadcast(df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))), F.lit(True))
    return joined.withColumn(f"{column}_z", (F.col(column) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def time_steps(frames: DataFrame, steps: DataFrame, frame: str = "frame") -> DataFrame:
    """frames plus `interval`: the interval of the first step (until_frame, interval) at or after the frame, of the last for later frames.

    The step table is a microscope's settings, a handful of rows: its bounds are made in one window.
    """
    w = Window.orderBy("until_frame")
    bounds = steps.select(F.coalesce(F.lag("until_frame").over(w), F.lit(-(2**62))).alias("_after"), F.when(F.lead("until_frame").over(w).isNull(), F.lit(2**62)).otherwise(F.col("until_frame")).alias("_upto"), "interval")
    return frames.join(F.broadcast(bounds), (F.col(frame) > F.col("_after")) & (F.col(frame) <= F.col("_upto")), "left").drop("_after", "_upto")
