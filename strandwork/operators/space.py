"""Joins in space and time: an equi-join on grid cells, never a cross join.

Coordinates are bucketed into cells of the radius; the query side is exploded to the neighbouring cells and joined
on (frame, cell), then filtered by exact distance. Each point has one cell, so no pair comes twice. plan="frame"
joins on the frame alone, which is cheaper where frames are small; plan="auto" takes it for the small frames and the
grid for the crowded ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import by_shuffle, saved
from .nearest import nearest

AXES = ("z", "y", "x")
#: Points of a frame from which the grid pays (its neighbour cells are 27 rows a query): measured on frames of up to 4,935 spots, where the frame plan took 2.4 s and the grid 9.0 s.
FRAME_PLAN_PAIRS = 8_000
#: Points at one place that a row of packs() holds at most.
PACK = 1024


def distance(axes: Sequence[str], a: str, b: str) -> Column:
    parts = [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in axes]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.sqrt(total)


def within(queries: DataFrame, points: DataFrame, radius: float, frames: int = 0, axes: Sequence[str] = AXES, frame: str = "frame", plan: str = "auto") -> DataFrame:
    """Pairs of a query row and a point within radius (inclusive) and within frames: columns q_*, p_*, distance, gap.

    Both sides have `frame` and the axes. Null coordinates pair with nothing.
    """
    q, p = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]), points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns])
    q = q.withColumn("_f", F.explode(F.sequence(F.col(f"q_{frame}") - frames, F.col(f"q_{frame}") + frames))) if frames else q.withColumn("_f", F.col(f"q_{frame}"))
    p = p.withColumn("_f", F.col(f"p_{frame}"))
    if plan == "auto":
        crowded = saved(p.groupBy("_f").agg(F.count("*").alias("n")).where(F.col("n") > FRAME_PLAN_PAIRS).select(F.col("_f").alias(frame)), "crowded")
        if crowded.isEmpty():
            plan = "frame"
        else:
            near = queries
            if frames:  # a query goes with each frame that it reaches
                near = queries.withColumn("_own", F.col(frame)).withColumn(frame, F.explode(F.sequence(F.col(frame) - frames, F.col(frame) + frames)))
            few, many = near.join(F.broadcast(crowded), frame, "left_anti"), near.join(F.broadcast(crowded), frame, "left_semi")  # one row per frame
            both = within(few, points, radius, 0, axes, frame, "frame").unionByName(within(many, points, radius, 0, axes, frame, "grid"))
            if frames:
                both = both.withColumn(f"q_{frame}", F.col("q__own")).drop("q__own").withColumn("gap", F.abs(F.col(f"q_{frame}") - F.col(f"p_{frame}")))
            return both
    keys = ["_f"]
    if plan == "grid":
        for c in axes:
            near = F.floor(F.col(f"q_{c}") / radius)
            q = q.withColumn(f"_{c}", F.explode(F.sequence(near - 1, near + 1)))
            p = p.withColumn(f"_{c}", F.floor(F.col(f"p_{c}") / radius))
            keys.append(f"_{c}")
        q = q.hint("merge")  # Spark's size of a table does not count what explode makes of it: 27 rows a query are not for a broadcast
    pairs = q.join(p, keys).withColumn("distance", distance(axes, "q_", "p_")).where(F.col("distance") <= radius)
    return pairs.withColumn("gap", F.abs(F.col(f"q_{frame}") - F.col(f"p_{frame}"))).drop(*keys)


def nearest_within(queries: DataFrame, points: DataFrame, radius: float, frames: int = 0, key: str = "id", point_key: str = "spot_id", axes: Sequence[str] = AXES, frame: str = "frame") -> DataFrame:
    """For each query row with a point within radius and frames, the one of least gap + distance (ties by point_key): q_key, the other q_* and p_*, distance, gap.

    By descent through a pyramid of cells (nearest.py) in each frame that the query reaches: rows don't grow with the points that lie within radius.
    """
    q = queries.select(F.struct(*queries.columns).alias("q"), frame, *axes)
    reach = F.explode(F.sequence(F.col(f"q.{frame}") - frames, F.col(f"q.{frame}") + frames))
    q = q.withColumn(frame, reach).withColumn("_gap", F.abs(F.col(f"q.{frame}") - F.col(frame))) if frames else q
    found = nearest(q, points, 1, "q", point_key, axes, frame, [c for c in points.columns if c != point_key], radius, "_gap" if frames else None)
    pairs = found.select(*[F.col(f"q_q.{c}").alias(f"q_{c}") for c in queries.columns], *[f"p_{c}" for c in points.columns], "distance")
    pairs = pairs.withColumn("gap", F.abs(F.col(f"q_{frame}") - F.col(f"p_{frame}")))
    order = F.struct((F.col("gap") + F.col("distance")).alias("cost"), F.col(f"p_{point_key}").alias("k"))
    best = pairs.groupBy(f"q_{key}").agg(F.min_by(F.struct(*[c for c in pairs.columns if c != f"q_{key}"]), order).alias("_b"))
    return best.select(f"q_{key}", "_b.*")


def filter_score(detections: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Detections with a score strictly above the cutoff."""
    return detections.where(F.col("score") > cutoff)


def match_detections(detections: DataFrame, spots: DataFrame, cutoff: float = 0.5, radius: float = 5.0) -> DataFrame:
    """(det_id, spot_id, distance) for detections (det_id, t, z, y, x, score) with score strictly above the cutoff."""
    asked = filter_score(detections, cutoff).withColumnRenamed("t", "frame")
    return nearest_within(asked, spots.select("spot_id", "frame", *AXES), radius, 0, "det_id").select(F.col("q_det_id").alias("det_id"), F.col("p_spot_id").alias("spot_id"), "distance")


def tracks_at_annotations(annotations: DataFrame, spots: DataFrame, radius: float = 15.0, frames: int = 0) -> DataFrame:
    """(ann_id, spot_id, track_id) of the spot nearest to each annotation."""
    found = nearest_within(annotations.withColumnRenamed("t", "frame"), spots.select("spot_id", "track_id", "frame", *AXES), radius, frames, "ann_id")
    return found.select(F.col("q_ann_id").alias("ann_id"), F.col("p_spot_id").alias("spot_id"), F.col("p_track_id").alias("track_id"))


def label_from_ground_truth(truth: DataFrame, spots: DataFrame, pieces: DataFrame, radius: float, label: str = "cell_type", key: str = "ann_id") -> DataFrame:
    """(spot_id, label): the label of the nearest point goes to the whole tracklet; of several the last truth row wins."""
    found = nearest_within(truth.withColumnRenamed("t", "frame"), spots.select("spot_id", "frame", *AXES), radius, 0, key).select(F.col(f"q_{key}").alias("_o"), F.col("p_spot_id").alias("spot_id"), F.col(f"q_{label}").alias("_l"))
    by_piece = found.join(pieces.select("spot_id", "head"), "spot_id").groupBy("head").agg(F.max_by("_l", "_o").alias(label))
    return pieces.select("spot_id", "head").join(by_piece, "head").select("spot_id", label)


def packs(points: DataFrame, key: str = "spot_id", axes: Sequence[str] = AXES, frame: str = "frame", size: int = PACK) -> DataFrame:
    """(frame, axes, pack, ids): points at one place as one row with their keys, `size` at most; a place of more has several, numbered by pack."""
    place = [frame, *axes]
    number = F.row_number().over(Window.partitionBy(*place).orderBy(key)) - 1
    return points.select(*place, key).withColumn("pack", F.floor(number / size)).groupBy(*place, "pack").agg(F.collect_list(key).alias("ids"))


def neighbours_within(spots: DataFrame, radius: float, **options) -> DataFrame:
    """(spot_id, frame, track_id): tracks with a spot within radius in the frame, the spot's own included.

    Places are met, each once, and get the tracks near them; spots get those of their place, which is the result and goes through no further shuffle.
    """
    rows = by_shuffle(saved(spots.select("spot_id", "track_id", "frame", *AXES), "spots"))
    place = ["frame", *AXES]
    places = by_shuffle(saved(rows.select(*place).distinct(), "places"))  # both sides are read from it
    near = within(places, places, radius, **options).select(*[f"{s}_{c}" for s in "qp" for c in place])
    tracks = rows.select("track_id", *[F.col(c).alias(f"p_{c}") for c in place]).distinct()
    near = near.join(by_shuffle(tracks), [f"p_{c}" for c in place]).select(*[F.col(f"q_{c}").alias(c) for c in place], "track_id").distinct()
    return rows.select("spot_id", *place).join(near, place).select("spot_id", "frame", "track_id")


def knn(queries: DataFrame, points: DataFrame, k: int, key: str = "id", point_key: str = "spot_id", axes: Sequence[str] = AXES) -> DataFrame:
    """(q_key, p_point_key, rank, distance): the k nearest points of the query's frame, by distance then point_key.

    Found by descent through a pyramid of cells (nearest.py): a query meets a few cells a level, however far its
    neighbours are. Frames without points are not asked.
    """
    return nearest(queries, points, k, key, point_key, axes)


def distance_to_boundary(spots: DataFrame, boundary: DataFrame) -> DataFrame:
    """(spot_id, distance_cell_mask, mask_centroid_*): nearest boundary point of the frame and the boundary's mean; 0 and 1, 1, 1 without a mask."""
    points = boundary.withColumn("spot_id", F.xxhash64("frame", *AXES))
    near = knn(spots.select("spot_id", "frame", *AXES), points, 1, "spot_id", "spot_id").select(F.col("q_spot_id").alias("spot_id"), "distance")
    middle = boundary.groupBy("frame").agg(*[F.avg(c).alias(f"mask_centroid_{c}") for c in AXES])
    df = spots.select("spot_id", "frame").join(near, "spot_id", "left").join(middle, "frame", "left")
    return df.select("spot_id", F.coalesce("distance", F.lit(0.0)).alias("distance_cell_mask"), *[F.coalesce(f"mask_centroid_{c}", F.lit(1.0)).alias(f"mask_centroid_{c}") for c in AXES])


def label_density(spots: DataFrame, voxels: DataFrame, size: float) -> DataFrame:
    """(spot_id, local_density): distinct labels, background counted, in a box of 4 sizes around the spot (2 to each side, inclusive).

    The box is a band join on cells of the box's half width, of the spots in frames that have voxels.
    """
    seen = F.broadcast(voxels.select("t").distinct())  # one row per frame
    half, q, v = 2.0 * size, spots.select("spot_id", F.col("frame").alias("t"), *AXES).join(seen, "t", "left_semi"), voxels.select("t", *[F.col(c).alias(f"v{c}") for c in AXES], "label")
    for c in AXES:
        near = F.floor(F.col(c) / half)
        q, v = q.withColumn(f"_{c}", F.explode(F.sequence(near - 1, near + 1))), v.withColumn(f"_{c}", F.floor(F.col(f"v{c}") / half))
    inside = q.hint("merge").join(v, ["t", *[f"_{c}" for c in AXES]]).where(" and ".join(f"abs({c} - v{c}) <= {half}" for c in AXES))
    return spots.select("spot_id").join(inside.groupBy("spot_id").agg(F.countDistinct("label").alias("local_density")), "spot_id", "left").select("spot_id", F.coalesce("local_density", F.lit(0)).alias("local_density"))


def match_second_channel(spots: DataFrame, regions: DataFrame, reach: float) -> DataFrame:
    """(spot_id, label, c2_*, c2_intensity, c2_size): the nearest region (t, label, z, y, x, z_size, y_size, x_size, total) if it is within twice the radius of the sphere of its bounding box's volume.

    reach bounds that distance for the join; a larger one only costs time.
    """
    pairs = within(spots.select("spot_id", "frame", *AXES), regions.withColumnRenamed("t", "frame"), reach)
    sphere = F.cbrt(3 * F.col("p_z_size") * F.col("p_y_size") * F.col("p_x_size") / (4 * F.pi()))
    best = pairs.groupBy("q_spot_id").agg(F.min_by(F.struct("p_label", *[f"p_{c}" for c in AXES], "p_total", sphere.alias("s"), "distance"), F.struct("distance", "p_label")).alias("b")).where("b.distance <= 2 * b.s")
    return best.select(F.col("q_spot_id").alias("spot_id"), F.col("b.p_label").alias("label"), *[F.col(f"b.p_{c}").alias(f"c2_{c}") for c in AXES], F.col("b.p_total").alias("c2_intensity"), F.col("b.s").alias("c2_radius"))


def attach_regions(spots: DataFrame, regions: DataFrame, reach: float, carry: Sequence[str] = ()) -> DataFrame:
    """(spot_id, label, region_radius, carry): the nearest region descriptor closer than the cube root of its eigenvalues' product, which becomes the radius.

    carry names further columns of regions that the spot gets: eccentricities, area, angles of its longest axis.
    """
    pairs = within(spots.select("spot_id", "frame", *AXES), regions.withColumnRenamed("t", "frame"), reach)
    size = F.cbrt(F.col("p_eigen_first") * F.col("p_eigen_second") * F.col("p_eigen_third"))
    best = pairs.groupBy("q_spot_id").agg(F.min_by(F.struct("p_label", size.alias("s"), "distance", *[f"p_{c}" for c in carry]), F.struct("distance", "p_label")).alias("b")).where("b.distance < b.s")
    return best.select(F.col("q_spot_id").alias("spot_id"), F.col("b.p_label").alias("label"), F.col("b.s").alias("region_radius"), *[F.col(f"b.p_{c}").alias(c) for c in carry])


def attach_latent(spots: DataFrame, latents: DataFrame, reach: float) -> DataFrame:
    """(spot_id, latent): the nearest latent vector (frame, z, y, x, latent_id, latent) within the spot's radius; radius must be above 0."""
    found = nearest_within(spots.where("radius > 0").select("spot_id", "radius", "frame", *AXES), latents, reach, 0, "spot_id", "latent_id")
    return found.where("distance < q_radius").select(F.col("q_spot_id").alias("spot_id"), F.col("p_latent").alias("latent"))


def transfer_positions(annotations: DataFrame, regions: DataFrame, radius: float = 10.0) -> DataFrame:
    """(ann_id, t, z, y, x): annotations moved to the nearest region centroid of their frame within radius; others are dropped."""
    found = nearest_within(annotations.withColumnRenamed("t", "frame"), regions.withColumnRenamed("t", "frame"), radius, 0, "ann_id", "label")
    return found.select(F.col("q_ann_id").alias("ann_id"), F.col("p_frame").alias("t"), *[F.col(f"p_{c}").alias(c) for c in AXES])


def exact_position_join(rows: DataFrame, spots: DataFrame, places: int = 6) -> DataFrame:
    """Rows joined with spots at the same (frame, z, y, x), rounded to places."""
    at = [F.round(F.col(c), places).alias(f"_{c}") for c in AXES]
    return rows.select("*", *at).join(spots.select("spot_id", "track_id", "frame", *at), ["frame", *[f"_{c}" for c in AXES]]).drop(*[f"_{c}" for c in AXES])


def shared_positions(rows: DataFrame, columns: Sequence[str] = ("frame", "z", "y", "x")) -> DataFrame:
    """Rows whose position occurs more than once."""
    return rows.join(rows.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), list(columns), "left_semi")
