"""Voxel tables: label images as rows (t, z, y, x, value, label)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import in_blocks

AXES = ("z", "y", "x")


def regions(voxels: DataFrame) -> DataFrame:
    """(t, label, centroid, size, bounding box, mean_value, total) of every labelled region."""
    return voxels.where("label > 0").groupBy("t", "label").agg(
        *[F.avg(c).alias(c) for c in AXES], F.count("*").alias("size"), *[f(c).alias(f"{c}_{n}") for c in AXES for f, n in ((F.min, "min"), (F.max, "max"))],
        F.avg("value").alias("mean_value"), F.sum("value").alias("total"),
    )


def neighbours(voxels: DataFrame) -> DataFrame:
    """voxels plus the places (nz, ny, nx) of their six neighbours, one row each."""
    steps = F.array(*[F.struct(*[F.lit(s if a == c else 0).alias(f"d{c}") for c in AXES]) for a in AXES for s in (-1, 1)])
    return voxels.withColumn("_d", F.explode(steps)).select("*", *[(F.col(c) + F.col(f"_d.d{c}")).alias(f"n{c}") for c in AXES]).drop("_d")


def boundary_pairs(voxels: DataFrame, missing_is_outside: bool = False, outer: bool = False) -> DataFrame:
    """Foreground voxels with each neighbour that is background (or, if asked, missing: outside of the image); with outer, background voxels with each neighbour that is foreground."""
    if outer:
        other = voxels.where("label > 0").select("t", *[F.col(c).alias(f"n{c}") for c in AXES], F.col("label").alias("n_label"))
        return neighbours(voxels.where("label = 0")).join(other, ["t", "nz", "ny", "nx"])
    other = voxels.select("t", *[F.col(c).alias(f"n{c}") for c in AXES], F.col("label").alias("n_label"))
    pairs = neighbours(voxels.where("label > 0")).join(other, ["t", "nz", "ny", "nx"], "left" if missing_is_outside else "inner")
    return pairs.where(F.coalesce("n_label", F.lit(0)) == 0)


def boundary_voxels(voxels: DataFrame, scale: tuple[float, float, float] = (1.0, 1.0, 1.0), missing_is_outside: bool = False, outer: bool = False) -> DataFrame:
    """(t, z, y, x): boundary voxels in units: foreground beside background, or with outer the background ones beside foreground."""
    return boundary_pairs(voxels, missing_is_outside, outer).select("t", *[(F.col(c) * s).alias(c) for c, s in zip(AXES, scale)]).distinct()


def centroid_of_boundary(boundary: DataFrame) -> DataFrame:
    return boundary.groupBy("t").agg(*[F.avg(c).alias(c) for c in AXES])


def exposed_area(voxels: DataFrame, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(t, label, area): faces of a region's voxels towards other labels or missing voxels."""
    z, y, x = scale
    face = F.when(F.col("nz") != F.col("z"), F.lit(y * x)).when(F.col("ny") != F.col("y"), F.lit(z * x)).otherwise(F.lit(z * y))
    same = voxels.select("t", "label", *[F.col(c).alias(f"n{c}") for c in AXES])
    return neighbours(voxels.where("label > 0")).join(same, ["t", "label", "nz", "ny", "nx"], "left_anti").groupBy("t", "label").agg(F.sum(face).alias("area"))


def largest_component(voxels: DataFrame) -> DataFrame:
    """Foreground voxels (any label) of the largest connected part of each frame; of equal ones the one with the smallest first voxel.

    Labels are numbers by (z, y, x); each round takes the smallest of a voxel and its neighbours and then follows
    labels one step, so a part of diameter d needs about log2(d) rounds. Rounds are written to the shared folder.
    """
    from .lineage import saved

    place = F.struct(*AXES)
    on = voxels.where("label > 0").select("t", *AXES)
    edges = saved(neighbours(on).join(on.select("t", *[F.col(c).alias(f"n{c}") for c in AXES]), ["t", "nz", "ny", "nx"]).select("t", place.alias("u"), F.struct(*[F.col(f"n{c}").alias(c) for c in AXES]).alias("v")), "voxel-edges")
    state = saved(on.select("t", place.alias("node"), place.alias("part")), "parts")
    while True:
        near = edges.join(state.select("t", F.col("node").alias("v"), "part"), ["t", "v"]).groupBy("t", F.col("u").alias("node")).agg(F.min("part").alias("near"))
        step = state.join(near, ["t", "node"], "left").select("t", "node", F.col("part").alias("old"), F.least("part", "near").alias("part"))
        new = saved(step.join(step.select("t", F.col("node").alias("part"), F.col("part").alias("above")), ["t", "part"], "left").select("t", "node", "old", F.least("part", "above").alias("part")), "parts")
        state = new.select("t", "node", "part")
        if new.where("old <> part").isEmpty():
            break
    sizes = state.groupBy("t", "part").agg(F.count("*").alias("n"))
    best = sizes.groupBy("t").agg(F.max_by("part", F.struct("n", F.struct(*[-F.col(f"part.{c}") for c in AXES]))).alias("part"))
    return state.join(best, ["t", "part"], "left_semi").select("t", "node.*")


def frame_mask(voxels: DataFrame) -> DataFrame:
    """The default mask: all but a border of one voxel in y and x of the table's extents."""
    ends = voxels.agg(*[f(c).alias(f"{c}_{n}") for c in ("y", "x") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return voxels.join(F.broadcast(ends), F.lit(True)).where("y > y_lo and y < y_hi and x > x_lo and x < x_hi").select(*voxels.columns)


def widest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(m): the largest distance between a point of a and one of b."""
    p, q = (x[list(AXES)].to_numpy(float) for x in (a, b))
    square = sum((p[:, [i]] - q[:, i][None, :]) ** 2 for i in range(len(AXES)))
    return pd.DataFrame({"m": [float(np.sqrt(square.max()))]})


def cell_size(voxels: DataFrame, default: float = 50.0, top: int = 10) -> DataFrame:
    """(cell_size): the largest distance across one of the `top` biggest regions of frames 0 and half-way; the default without any.

    Only the ends of each region's rows of voxels can be farthest apart, and only those are compared, block by block.
    """
    half = voxels.agg(F.floor((F.max("t") + 1) / 2).alias("h"))
    chosen = voxels.where("label > 0").join(F.broadcast(half), F.lit(True)).where("t = 0 or t = h").drop("h")
    sizes = chosen.groupBy("t", "label").agg(F.count("*").alias("n"))
    big = sizes.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("n"), "label"))).where(F.col("r") <= top).select("t", "label")
    ends = chosen.join(big, ["t", "label"]).groupBy("t", "label", "z", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    ends = ends.select("t", "label", "z", "y", F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))
    ends = ends.withColumn("id", F.xxhash64(*AXES))
    far = in_blocks(ends, ends, ["t", "label"], widest, "m double")
    return far.agg(F.coalesce(F.max("m"), F.lit(default)).alias("cell_size"))


def with_eigenvalues(df: DataFrame) -> DataFrame:
    """df plus eigen_first, _second, _third, of the symmetric 3 x 3 matrix in its columns zz, yy, xx, zy, zx, yx: the closed form by cosines.

    Each step is a column of its own, used by the next: as one expression it would be more code than a method may have.
    """
    c = F.col
    df = df.withColumn("_q", (c("zz") + c("yy") + c("xx")) / 3)
    df = df.withColumns({f"_{k}": c(k) - c("_q") for k in ("zz", "yy", "xx")})
    df = df.withColumn("_p", F.sqrt((c("_zz") * c("_zz") + c("_yy") * c("_yy") + c("_xx") * c("_xx") + 2 * (c("zy") * c("zy") + c("zx") * c("zx") + c("yx") * c("yx"))) / 6))
    det = c("_zz") * (c("_yy") * c("_xx") - c("yx") * c("yx")) - c("zy") * (c("zy") * c("_xx") - c("yx") * c("zx")) + c("zx") * (c("zy") * c("yx") - c("_yy") * c("zx"))
    df = df.withColumn("_half", det / F.nullif(c("_p") * c("_p") * c("_p"), F.lit(0.0)) / 2)
    df = df.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("_half")))) / 3)
    df = df.withColumns({"eigen_first": F.coalesce(c("_q") + 2 * c("_p") * F.cos("_phi"), c("_q")), "eigen_third": F.coalesce(c("_q") + 2 * c("_p") * F.cos(c("_phi") + 2 * F.pi() / 3), c("_q"))})
    df = df.withColumn("eigen_second", 3 * c("_q") - c("eigen_first") - c("eigen_third"))
    return df.withColumns({f"eigen_{n}": F.greatest(c(f"eigen_{n}"), F.lit(0.0)) for n in ("first", "second", "third")}).drop("_q", "_zz", "_yy", "_xx", "_p", "_half", "_phi")


def with_long_axis(df: DataFrame) -> DataFrame:
    """df plus cell_axis_z, _y, _x: degrees (0 to 90) between the line of the matrix's largest eigenvalue and each axis; null where it is not single.

    The eigenvector is the longest of the cross products of the rows of the matrix less the eigenvalue: each is along it or 0.
    """
    c = F.col
    df = df.withColumns({f"_{k}": c(k) - c("eigen_first") for k in ("zz", "yy", "xx")})
    rows = (("_zz", "zy", "zx"), ("zy", "_yy", "yx"), ("zx", "yx", "_xx"))
    cross = lambda u, v: [c(u[1]) * c(v[2]) - c(u[2]) * c(v[1]), c(u[2]) * c(v[0]) - c(u[0]) * c(v[2]), c(u[0]) * c(v[1]) - c(u[1]) * c(v[0])]
    for n, (i, k) in enumerate(((0, 1), (0, 2), (1, 2))):
        df = df.withColumns({f"_{n}{x}": v for x, v in zip(AXES, cross(rows[i], rows[k]))})
    df = df.withColumns({f"_n{n}": F.sqrt(c(f"_{n}z") * c(f"_{n}z") + c(f"_{n}y") * c(f"_{n}y") + c(f"_{n}x") * c(f"_{n}x")) for n in range(3)})
    df = df.withColumn("_longest", F.greatest("_n0", "_n1", "_n2"))
    single = (c("eigen_first") - c("eigen_second")) > 1e-6 * c("eigen_first")
    part = lambda x: F.coalesce(*[F.when(c(f"_n{n}") == c("_longest"), F.abs(f"_{n}{x}")) for n in range(3)])
    angles = {f"cell_axis_{x}": F.when(single, F.degrees(F.acos(F.least(F.lit(1.0), part(x) / F.nullif("_longest", F.lit(0.0)))))) for x in AXES}
    return df.withColumns(angles).drop("_zz", "_yy", "_xx", *[f"_{n}{x}" for n in range(3) for x in AXES], "_n0", "_n1", "_n2", "_longest")


def shape_moments(voxels: DataFrame) -> DataFrame:
    """(t, label, eccentricity_*, eigen_*, cell_axis_*) of a region's voxels.

    Eigenvalues of their covariance (largest first), their square roots, and the angles in degrees of the longest axis with
    z, y and x (null where two axes are longest). Regions of under four voxels have none.
    """
    pairs = [("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x")]
    cov = voxels.where("label > 0").groupBy("t", "label").agg(F.count("*").alias("n"), *[F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(a + b) for a, b in pairs]).where("n > 3")
    order = ("first", "second", "third")
    cov = with_long_axis(with_eigenvalues(cov))
    return cov.select("t", "label", *[F.sqrt(f"eigen_{n}").alias(f"eccentricity_{n}") for n in order], *[f"eigen_{n}" for n in order], *[f"cell_axis_{c}" for c in AXES])


def region_shapes(voxels: DataFrame) -> DataFrame:
    """(t, label, centroid, size, what shape_moments() gives, area) of frames with more than one usable region; null where a shape failed."""
    joined = regions(voxels).select("t", "label", *AXES, "size").join(shape_moments(voxels), ["t", "label"], "left").join(exposed_area(voxels), ["t", "label"], "left")
    many = joined.groupBy("t").agg(F.count("eccentricity_first").alias("n")).where("n > 1").select("t")
    return joined.join(many, "t", "left_semi")


def min_size(found: DataFrame, z: int, y: int, x: int) -> DataFrame:
    """Regions whose bounding box is at least z by y by x."""
    for c, n in zip(AXES, (z, y, x)):
        found = found.where(F.col(f"{c}_max") - F.col(f"{c}_min") + 1 >= n)
    return found


def sample_boundary(voxels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n boundary voxels of each region, by hash: sampling is the feature."""
    edge = boundary_pairs(voxels).select("t", "label", *AXES).distinct()
    return edge.withColumn("_r", F.row_number().over(Window.partitionBy("t", "label").orderBy(F.xxhash64(F.lit(seed), *AXES), *AXES))).where(F.col("_r") <= n).drop("_r")


def centre_cloud(points: DataFrame, by: list[str], scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Points less their group's mean, over scale."""
    means = points.groupBy(*by).agg(*[F.avg(c).alias(f"_{c}") for c in AXES])
    return points.join(means, by).withColumns({c: (F.col(c) - F.col(f"_{c}")) / s for c, s in zip(AXES, scale)}).drop(*[f"_{c}" for c in AXES])


def box_at_point(points: DataFrame, voxels: DataFrame, key: str) -> DataFrame:
    """(key, label, height, width, depth) of the region under each point (t, z, y, x)."""
    at = points.select(key, "t", *[F.bround(c, 0).cast("long").alias(c) for c in AXES]).join(voxels.where("label > 0").select("t", *AXES, "label"), ["t", *AXES])
    return at.select(key, "t", "label").join(regions(voxels), ["t", "label"]).select(key, "label", (F.col("y_max") - F.col("y_min") + 1).alias("height"), (F.col("x_max") - F.col("x_min") + 1).alias("width"), (F.col("z_max") - F.col("z_min") + 1).alias("depth"))


def crop_patches(rows: DataFrame, voxels: DataFrame, key: str, size: tuple[int, int, int]) -> DataFrame:
    """(key, t, z, y, x, dz, dy, dx, value): voxels in a box of size around each row (t, z, y, x), only for boxes that are complete.

    The box is a band join on cells of its half width, of the rows in frames that have voxels.
    """
    seen = F.broadcast(voxels.select("t").distinct())  # one row per frame
    half = [max(1, n // 2) for n in size]
    q, v = rows.join(seen, "t", "left_semi").select(key, "t", *[F.bround(c, 0).cast("long").alias(c) for c in AXES]), voxels.select("t", *[F.col(c).alias(f"v{c}") for c in AXES], "value")
    for c, h in zip(AXES, half):
        cell = F.floor(F.col(c) / h)
        q, v = q.withColumn(f"_{c}", F.explode(F.sequence(cell - 1, cell + 1))), v.withColumn(f"_{c}", F.floor(F.col(f"v{c}") / h))
    inside = q.hint("merge").join(v, ["t", *[f"_{c}" for c in AXES]])  # 27 rows a query are not for a broadcast
    for c, n in zip(AXES, size):
        inside = inside.where((F.col(f"v{c}") - F.col(c) >= -(n // 2)) & (F.col(f"v{c}") - F.col(c) < n - n // 2))
    inside = inside.select(key, "t", *AXES, *[(F.col(f"v{c}") - F.col(c)).alias(f"d{c}") for c in AXES], "value")
    full = inside.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == size[0] * size[1] * size[2])
    return inside.join(full.select(key), key, "left_semi")


def patch_labels(rows: DataFrame, voxels: DataFrame, key: str, size: tuple[int, int, int], classes: int, label: str = "class_no") -> DataFrame:
    """(key, label_vector) of rows (t, z, y, x, label: 0 .. classes - 1) on a region: 1 at the class, then place, extent and confidence of the region in its patch.

    After the classes: where the region's centre lies in a patch of size (z, y, x) cut around it, as parts of the patch by x, y, z; the region's
    height (y), width (x) and depth (z) as parts of the patch, a half where it fills the patch or more; 1 for the confidence. Rows on
    background, and those whose class is null or none of the classes, give no vector.
    """
    at = rows.select(key, "t", label, *[F.bround(c, 0).cast("long").alias(c) for c in AXES]).join(voxels.where("label > 0").select("t", *AXES, "label"), ["t", *AXES])
    own = regions(voxels).select("t", "label", *[F.col(c).alias(f"mid_{c}") for c in AXES], *[(F.col(f"{c}_max") - F.col(f"{c}_min") + 1).alias(f"long_{c}") for c in AXES])
    df = at.select(key, "t", "label", F.col(label).alias("_class")).join(own, ["t", "label"]).where(F.col("_class").between(0, classes - 1))
    n = dict(zip(AXES, size))
    place = [(F.col(f"mid_{c}") - (F.col(f"mid_{c}") - n[c] // 2)) / n[c] for c in ("x", "y", "z")]
    extent = [F.when(F.col(f"long_{c}") >= n[c], F.lit(0.5)).otherwise(F.col(f"long_{c}") / n[c]) for c in ("y", "x", "z")]
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == F.col("_class"), 1.0).otherwise(0.0))
    return df.select(key, F.concat(hot, F.array(*[x.cast("double") for x in (*place, *extent)], F.lit(1.0))).alias("label_vector"))


def percentile_normalise(voxels: DataFrame, low: float = 1.0, high: float = 99.8, chunk: int = 50, eps: float = 1e-20) -> DataFrame:
    """voxels plus `normalised`: value between its chunk of frames' low and high percentiles.

    Percentiles are of counted values: what one place holds is a chunk's distinct values, not its voxels.
    """
    counted = voxels.groupBy(F.floor(F.col("t") / chunk).alias("_c"), "value").agg(F.count("*").alias("_n"))
    ends = counted.groupBy("_c").agg(*[F.expr(f"percentile(value, {x / 100!r}, _n)").alias(n) for x, n in ((low, "_lo"), (high, "_hi"))])
    return voxels.withColumn("_c", F.floor(F.col("t") / chunk)).join(ends, "_c").withColumn("normalised", (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)).drop("_c", "_lo", "_hi")
