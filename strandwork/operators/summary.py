"""Aggregations over spots and features: per-frame cohorts, histograms, counts and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import histogram_bin, usable_radius, view_columns
from .blocks import before_in_order

MEASURES = ("radius", "speed", "acceleration", "motion_angle_z", "motion_angle_y", "motion_angle_x", "distance_cell_mask", "local_density")


def cohorts(dividing: Column, fate: Column) -> Column:
    """The cohorts of a spot: all, dividing or non-dividing, and its fate if it has one."""
    return F.array_compact(F.array(F.lit("all"), F.when(dividing, F.lit("dividing")).otherwise(F.lit("non_dividing")), fate))


def frame_summary(spots: DataFrame, cohorts: Column, measures: Sequence[str] = MEASURES) -> DataFrame:
    """(frame, cohort, n, mean and population deviation of each measure and of the change of position).

    cohorts is an array of the cohorts that a row is in. Change is the absolute difference to the spot before it in
    order of spot_id in its frame and cohort, as the summed tables have it; radii of 0 or less are missing. A frame of
    any size is worked on in runs of spot ids.
    """
    tagged = spots.withColumn("cohort", F.explode(cohorts))
    moved = before_in_order(tagged, ["frame", "cohort"], "spot_id", ["z", "y", "x"])
    moved = moved.withColumns({f"change_{c}": F.abs(F.col(c) - F.col(f"prior_{c}")) for c in ("z", "y", "x")})
    if "radius" in measures:
        moved = moved.withColumn("radius", usable_radius(F.col("radius")))
    columns = [*[f"change_{c}" for c in ("z", "y", "x")], *measures]
    return moved.groupBy("frame", "cohort").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def frame_counts(spots: DataFrame) -> DataFrame:
    return spots.groupBy("frame").agg(F.count("*").alias("spots"))


def division_counts(rows: DataFrame) -> DataFrame:
    """(frame, divisions): dividing rows at positions that occur more than once, halved."""
    from .space import shared_positions

    return shared_positions(rows.where("dividing")).groupBy("frame").agg((F.count("*") / 2).alias("divisions"))


def split_snapshot(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """All features of each split spot."""
    return rows.join(splits.select("spot_id"), "spot_id", "left_semi")


def values_by(rows: DataFrame, cohort: str, features: Sequence[str]) -> DataFrame:
    """(cohort, feature, value): long form of features by number of divisions or cell type."""
    return rows.where(F.col(cohort).isNotNull()).unpivot([cohort], list(features), "feature", "value")


def feature_histogram(values: DataFrame, bins: int = 20, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(by, bin, n): counts in bins of equal width between each group's least and largest value; groups are few, their ends go to all."""
    ends = values.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = values.where("value is not null").join(F.broadcast(ends), list(by)).withColumn("bin", histogram_bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def angle_histogram(rows: DataFrame, angle: str, frame: int, bins: int = 10, arrow: float = 20.0) -> DataFrame:
    """(bin, n, arrow_x, arrow_y): an angle's histogram in radians at one frame, and the mean end of arrows of a length."""
    at = rows.where(F.col("frame") == frame).select(F.radians(angle).alias("value"), F.lit(angle).alias("feature"))
    ends = at.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = at.join(F.broadcast(ends), "feature").withColumn("bin", histogram_bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.cos("value") * arrow).alias("arrow_x"), F.avg(F.sin("value") * arrow).alias("arrow_y"))


def quadrant_counts(rows: DataFrame, y_mid: float, x_mid: float, label: str) -> DataFrame:
    """(frame, quadrant, label, n): quadrant 0 to 3 by y then x above the middle."""
    quadrant = (F.col("y") >= y_mid).cast("int") * 2 + (F.col("x") >= x_mid).cast("int")
    return rows.groupBy("frame", quadrant.alias("quadrant"), label).agg(F.count("*").alias("n"))


def cluster_nearness(rows: DataFrame, label: str) -> DataFrame:
    """(frame, a, b, nearness): distance between the labels' centroids, added up over the frames."""
    c = rows.where(F.col(label).isNotNull()).groupBy("frame", F.col(label).alias("a")).agg(*[F.avg(x).alias(x) for x in ("z", "y", "x")])
    other = c.select("frame", F.col("a").alias("b"), *[F.col(x).alias(f"o{x}") for x in ("z", "y", "x")])
    d = F.sqrt((F.col("z") - F.col("oz")) ** 2 + (F.col("y") - F.col("oy")) ** 2 + (F.col("x") - F.col("ox")) ** 2)
    return c.join(other, "frame").where("a < b").select("frame", "a", "b", F.sum(d).over(Window.partitionBy("a", "b").orderBy("frame")).alias("nearness"))


def cluster_sizes(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def class_balanced_sample(tracklets: DataFrame, flag: str, ratio: float, seed: int = 0, key: str = "head") -> DataFrame:
    """All flagged tracklets, and at most ratio times as many others, the first in order of a hash: sampling is the feature.

    The hash's range is cut into 4,096 parts: counts tell which are taken whole, and only the part at the edge is sorted.
    """
    want = int(ratio * tracklets.where(flag).count())
    hashed = tracklets.where(~F.col(flag)).withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_part", F.shiftrightunsigned("_h", 52).cast("int"))
    parts = hashed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = hashed.join(F.broadcast(parts.withColumn("_before", before)), "_part").where(F.col("_before") < want)
    whole = dealt.where(F.col("_before") + F.col("_n") <= want)
    edge = dealt.where(F.col("_before") + F.col("_n") > want).withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_h", key)))
    others = whole.select(*tracklets.columns).unionByName(edge.where(F.col("_r") <= F.lit(want) - F.col("_before")).select(*tracklets.columns))
    return tracklets.where(flag).unionByName(others)


def grid_raster(rows: DataFrame, label: str, steps: tuple[int, int, int] = (1, 10, 10)) -> DataFrame:
    """(gt, gy, gx, label): the label of the last spot in each (t, y, x) cell."""
    cells = [F.floor(F.col(c) / s).alias(f"g{n}") for c, s, n in zip(("frame", "y", "x"), steps, "tyx")]
    return rows.select(*cells, "spot_id", label).groupBy("gt", "gy", "gx").agg(F.max_by(label, "spot_id").alias(label))


def path_heatmap(paths: DataFrame) -> DataFrame:
    """(t, z, y, x, hits) of rounded places, half to even."""
    return paths.groupBy("t", *[F.bround(c, 0).alias(c) for c in ("z", "y", "x")]).agg(F.count("*").alias("hits"))


def microdomains(rows: DataFrame, label: str, distance: str, start: int, end: int) -> DataFrame:
    """First row (by spot_id) per frame, label and tracklet in a range of frames; rows without a distance are dropped."""
    inside = rows.where(F.col(distance).isNotNull() & F.col("frame").between(start, end))
    first = Window.partitionBy("frame", label, "head").orderBy("spot_id")
    return inside.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def first_position(rows: DataFrame, label: str) -> DataFrame:
    """(track_id, label, t, z, y, x): the earliest place of each labelled track."""
    first = rows.where(F.col(label).isNotNull()).groupBy("track_id").agg(F.min_by(F.struct(label, F.col("frame").alias("t"), "z", "y", "x"), F.struct("frame", "spot_id")).alias("p"))
    return first.select("track_id", "p.*")


def coalesce_window_labels(rows: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(spot_id, frame, window, label): of columns named by the last frame of their window, each is used in its (start, end] frames."""
    long = rows.unpivot(["spot_id", "frame"], list(columns), "window", "label")
    ends = sorted(columns.items(), key=lambda x: x[1])
    bounds = F.create_map(*[F.lit(x) for i, (c, e) in enumerate(ends) for x in (c, ends[i - 1][1] if i else -1)])
    upto = F.create_map(*[F.lit(x) for c, e in ends for x in (c, e)])
    return long.where((F.col("frame") > F.element_at(bounds, F.col("window"))) & (F.col("frame") <= F.element_at(upto, F.col("window"))))


def region_of_interest(rows: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """Rows whose named columns are within inclusive bounds; simple comparisons, so that they reach a Parquet scan."""
    for c, (lo, hi) in bounds.items():
        rows = rows.where(F.col(c).between(lo, hi))
    return rows


def clip_roi(box: DataFrame, extents: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Bounds a_start, a_end clipped to 0 and the extents a_size (one row)."""
    joined = box.join(F.broadcast(extents.limit(1)), F.lit(True))
    return joined.select(*[e for a in axes for e in (F.greatest(F.lit(0), f"{a}_start").alias(f"{a}_start"), F.least(f"{a}_end", f"{a}_size").alias(f"{a}_end"))])


def select_features(rows: DataFrame, features: Sequence[str] | str, ignore: Sequence[str] = (), keys: Sequence[str] = ("spot_id",), label: str | None = None) -> DataFrame:
    """Keys and features less the ignored ones, and the label if one is named; rows with a null feature are dropped.

    features are columns, or the name of a view (shape, dynamic, shape_dynamic, full), which takes latent columns along.
    """
    if isinstance(features, str):
        features = [*view_columns(features), *[c for c in rows.columns if c.startswith("latent_")]]
    kept = [c for c in features if c not in ignore]
    return rows.select(*keys, *kept, *([label] if label is not None else [])).na.drop(subset=kept)


def cluster_scatter(rows: DataFrame, views: Sequence[str]) -> DataFrame:
    """(frame, y, x, view, label): points in long form, one row per view that has a label for them."""
    return rows.unpivot(["spot_id", "frame", "y", "x"], list(views), "view", "label").where("label is not null").drop("spot_id")


def labelled_tracklets(rows: DataFrame, labels: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features of spots with the label (spot_id, label) of their tracklet's first labelled spot."""
    first = rows.join(labels, "spot_id").groupBy("head").agg(F.min_by("label", F.struct("frame", "spot_id")).alias("label"))
    return rows.join(first, "head").select("spot_id", "head", *features, "label")
