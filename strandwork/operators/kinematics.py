"""Kinematics: speed, acceleration, angles and displacements of linked spots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import axis_angle
from .lineage import one_parent

POSITION = ("z", "y", "x")
#: Rows of a series that are transformed as one array.
MAX_SERIES = 1 << 16


def with_ancestors(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """spots plus parent and grandparent positions and frames (p1_*, p2_*), null where there is none."""
    up = one_parent(edges)
    at = lambda p: spots.select(F.col("spot_id").alias(f"{p}_id"), F.col("frame").alias(f"{p}_frame"), *[F.col(c).alias(f"{p}_{c}") for c in POSITION])
    df = spots.join(up.withColumnRenamed("parent", "p1_id"), "spot_id", "left").join(at("p1"), "p1_id", "left")
    return df.join(up.select(F.col("spot_id").alias("p1_id"), F.col("parent").alias("p2_id")), "p1_id", "left").join(at("p2"), "p2_id", "left")


def length(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def kinematics(spots: DataFrame, edges: DataFrame, interval: float = 1.0) -> DataFrame:
    """(spot_id, speed, acceleration, motion_angle_*, radial_angle_*) of every spot.

    Speed is the step's length over its frames (1 at least) times the interval, 0 at roots; acceleration the length
    of the second difference over the frames of both steps times the interval, once, 0 with under two ancestors.
    """
    df = with_ancestors(spots, edges)
    step = [F.col(c) - F.col(f"p1_{c}") for c in POSITION]
    bend = [F.col(c) - 2 * F.col(f"p1_{c}") + F.col(f"p2_{c}") for c in POSITION]
    gap = lambda p: F.greatest(F.lit(1), F.col("frame") - F.col(f"{p}_frame")) * interval
    here = [F.col(c) for c in POSITION]
    return df.select(
        "spot_id", "track_id", "frame", F.coalesce(length(step) / gap("p1"), F.lit(0.0)).alias("speed"), F.coalesce(length(bend) / gap("p2"), F.lit(0.0)).alias("acceleration"),
        *[F.coalesce(axis_angle(*step, c), F.lit(0.0)).alias(f"motion_angle_{c}") for c in POSITION], *[axis_angle(*here, c).alias(f"radial_angle_{c}") for c in POSITION],
    )


def root_displacement(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(spot_id, msd, recoil): squared and plain distance to the track's first root, by (frame, spot_id)."""
    from .lineage import roots

    first = roots(edges).join(spots.select("spot_id", "frame", *POSITION), "spot_id").groupBy("track_id").agg(F.min_by(F.struct(*POSITION), F.struct("frame", "spot_id")).alias("r"))
    df = spots.join(first, "track_id", "left")
    msd = sum(((F.col(c) - F.col(f"r.{c}")) * (F.col(c) - F.col(f"r.{c}")) for c in POSITION[1:]), (F.col("z") - F.col("r.z")) * (F.col("z") - F.col("r.z")))
    return df.select("spot_id", F.coalesce(msd, F.lit(0.0)).alias("msd"), F.sqrt(F.coalesce(msd, F.lit(0.0))).alias("recoil"))


def before_after(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(spot_id, before_id, after_id); the smallest child where the track splits."""
    after = edges.groupBy(F.col("source_id").alias("spot_id")).agg(F.min("target_id").alias("after_id"))
    return spots.select("spot_id").join(one_parent(edges).withColumnRenamed("parent", "before_id"), "spot_id", "left").join(after, "spot_id", "left")


def edge_steps(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the frames and the step (dz, dy, dx) they span, and its length."""
    at = spots.select("spot_id", "frame", *POSITION)
    a = at.select(F.col("spot_id").alias("source_id"), F.col("frame").alias("from_frame"), *[F.col(c).alias(f"_{c}") for c in POSITION])
    b = at.select(F.col("spot_id").alias("target_id"), F.col("frame").alias("to_frame"), *POSITION)
    df = edges.join(a, "source_id").join(b, "target_id")
    steps = {f"d{c}": F.col(c) - F.col(f"_{c}") for c in POSITION}
    return df.withColumns(steps).withColumn("displacement", length([F.col("dz"), F.col("dy"), F.col("dx")])).select("track_id", "source_id", "target_id", "from_frame", "to_frame", "dz", "dy", "dx", "displacement")


def track_summary(spots: DataFrame, edges: DataFrame, interval: float = 1.0) -> DataFrame:
    """The track measures, one row per track. Displacement is from the first to the last spot by (frame, spot_id); mean_quality comes along where spots have a quality."""
    from .lineage import gaps, merges, splits

    moved = edge_steps(spots, edges).withColumn("speed", F.col("displacement") / (F.greatest(F.lit(1), F.col("to_frame") - F.col("from_frame")) * interval))
    steps = moved.groupBy("track_id").agg(
        F.sum("displacement").alias("total_distance"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("max_speed"), F.min("speed").alias("min_speed"),
        F.percentile("speed", 0.5).alias("median_speed"), F.stddev_samp("speed").alias("std_speed"),
    )
    place = F.struct(*POSITION)
    base = spots.groupBy("track_id").agg(
        *([F.avg("quality").alias("mean_quality")] if "quality" in spots.columns else []), F.count("*").alias("number_spots"), F.min("frame").alias("start"), F.max("frame").alias("stop"), *[F.avg(c).alias(f"mean_{c}") for c in POSITION],
        F.min_by(place, F.struct("frame", "spot_id")).alias("_a"), F.max_by(place, F.struct("frame", "spot_id")).alias("_b"),
    )
    first = spots.join(base.select("track_id", "_a"), "track_id").groupBy("track_id").agg(F.max(length([F.col(c) - F.col(f"_a.{c}") for c in POSITION])).alias("max_distance"))
    counts = [(splits(edges), "number_splits"), (merges(edges), "number_merges"), (gaps(edges, spots), "number_gaps")]
    out = base.join(steps, "track_id", "left").join(first, "track_id")
    for df, name in counts:
        out = out.join(df.groupBy("track_id").agg(F.count("*").alias(name)), "track_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    out = out.withColumn("duration", (F.col("stop") - F.col("start")) * interval).withColumn("displacement", length([F.col(f"_b.{c}") - F.col(f"_a.{c}") for c in POSITION]))
    straight = F.col("displacement") / F.nullif(F.col("duration").cast("double"), F.lit(0.0))
    return out.withColumn("straight_speed", straight).withColumn("linearity", straight / F.nullif("mean_speed", F.lit(0.0))).drop("_a", "_b")


def broadcast_track_stats(spots: DataFrame, summary: DataFrame, columns: list[str]) -> DataFrame:
    """(spot_id, columns): a track's measures copied to its spots."""
    return spots.select("spot_id", "track_id").join(summary.select("track_id", *columns), "track_id").drop("track_id")


def mean_square_lag(points: DataFrame, max_lag: int) -> DataFrame:
    """(lag, pairs, mean_square) over points (key, i, z, y, x): mean squared displacement of points of one key that are lag places apart.

    The smaller lags are exploded and equi-joined: max_lag rows per point, no cross join.
    """
    a = points.select("key", (F.col("i")).alias("_i"), *[F.col(c).alias(f"_{c}") for c in POSITION]).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("i", F.col("_i") + F.col("lag"))
    square = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in POSITION[1:]), (F.col("z") - F.col("_z")) ** 2)
    return a.join(points, ["key", "i"]).groupBy("lag").agg(F.count("*").alias("pairs"), F.avg(square).alias("mean_square"))


def intensity_spectrum(series: DataFrame, interval: float = 1.0, most: int = MAX_SERIES) -> DataFrame:
    """(key, k, frequency, magnitude) of series (key, i, value): the first half of each key's discrete Fourier transform, by its own length.

    i counts a key's rows from 0; a null value is 0. Each key is one array, transformed in n log n steps. One of more than `most` rows is dealt to
    its rows at every r-th place, r the smallest divisor of its length that makes them short enough; their transforms
    are then put together, r terms for each frequency. (A length without such a divisor up to `most` goes whole.)
    """
    @F.pandas_udf("struct<re: array<double>, im: array<double>>")
    def transformed(values: pd.Series) -> pd.DataFrame:
        waves = [np.fft.fft(np.nan_to_num(np.asarray(v, float))) for v in values]
        return pd.DataFrame({"re": [w.real for w in waves], "im": [w.imag for w in waves]})

    n = series.groupBy("key").agg(F.count("*").alias("n"))
    few = F.expr(f"try_element_at(filter(sequence(2, {most}), d -> n % d = 0 AND n div d <= {most}), 1)")
    n = n.withColumn("r", F.when(F.col("n") <= most, F.lit(1)).otherwise(F.coalesce(few, F.lit(1))))
    dealt = series.join(n, "key").groupBy("key", "n", "r", (F.col("i") % F.col("r")).alias("j"))
    arrays = dealt.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("v"))
    waves = arrays.select("key", "n", "r", "j", transformed("v").alias("w"))
    whole = F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int"))
    at = waves.select("key", "n", "r", "j", F.posexplode(F.arrays_zip("w.re", "w.im")).alias("k", "x"))
    short = at.where(F.col("r") == 1).where(F.col("k") < whole).select("key", "n", "k", F.col("x.re").alias("_re"), F.col("x.im").alias("_im"))
    turn = F.col("j") * F.col("k") * (-2 * math.pi) / F.col("n")
    long = at.where(F.col("r") > 1).withColumn("k", F.explode(F.sequence(F.col("k"), (F.col("n") - 1).cast("int"), (F.col("n") / F.col("r")).cast("int")))).where(F.col("k") < whole)
    long = long.groupBy("key", "n", "k").agg(F.sum(F.col("x.re") * F.cos(turn) - F.col("x.im") * F.sin(turn)).alias("_re"), F.sum(F.col("x.re") * F.sin(turn) + F.col("x.im") * F.cos(turn)).alias("_im"))
    return short.unionByName(long).select("key", "k", (F.col("k") / (F.col("n") * interval)).alias("frequency"), F.sqrt(F.col("_re") ** 2 + F.col("_im") ** 2).alias("magnitude"))
