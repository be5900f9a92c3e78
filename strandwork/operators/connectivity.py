"""Connectivity of points per frame: edges below a scale, component barcodes, simplex counts and bar statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import space
from .lineage import by_shuffle, saved


def frame_points(spots: DataFrame, normalise: bool = False, axes: Sequence[str] = space.AXES) -> DataFrame:
    """Null-free points; normalise: over each frame's mean and population deviation (0 becomes 1)."""
    rows = spots.select("spot_id", "frame", *axes).na.drop()
    if not normalise:
        return rows
    stats = rows.groupBy("frame").agg(*[f(c).alias(f"{c}_{n}") for c in axes for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    scale = lambda c: F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s"))
    return rows.join(F.broadcast(stats), "frame").select("spot_id", "frame", *[((F.col(c) - F.col(f"{c}_m")) / scale(c)).alias(c) for c in axes])


def rips_edges(points: DataFrame, scale: float, **options) -> DataFrame:
    """(frame, a, b, distance) of pairs within a scale. Places are met, with the points at them in packs, so that copies of a point go through no shuffle of their own."""
    held = by_shuffle(saved(space.packs(points), "packs"))
    order = lambda side: F.struct(*[f"{side}_{c}" for c in (*space.AXES, "pack")])
    met = space.within(held, held, scale, **options).where(order("q") <= order("p"))
    pairs = met.select(F.col("q_frame").alias("frame"), "distance", (order("q") == order("p")).alias("own"), F.explode("q_ids").alias("u"), "p_ids").select("frame", "distance", "own", "u", F.explode("p_ids").alias("v"))
    return pairs.where("u < v or (u > v and not own)").select("frame", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "distance")


def places(points: DataFrame, axes: Sequence[str] = space.AXES) -> DataFrame:
    """(spot_id, frame, axes, n): points at one place as one, the one of the smallest id, and how many there are; points that are not at a finite place stay as they are."""
    finite = reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in axes])
    return points.groupBy("frame", *axes, F.when(~finite, F.col("spot_id")).alias("_own")).agg(F.min("spot_id").alias("spot_id"), F.count("*").alias("n")).drop("_own")


def forest_round(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over edges (a, b, e) between parts, e (distance, a, b, frame) the lightest between the two: (chosen edges, edges between what they join).

    Each part takes the lightest of its edges, ties by ids, so the chosen ones make trees, in which the pair that chose the same
    edge is the root's; pointers are followed and doubled up to it. Then the ends of the edges are renamed to roots, those
    within a part go, and of those between two parts the lightest stays: at most half as many parts are left.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("part"), F.col("b").alias("other")), F.struct(F.col("b").alias("part"), F.col("a").alias("other"))))
    best = saved(parts.select(ends.alias("x"), "e").groupBy("x.part").agg(F.min_by("x.other", "e").alias("up"), F.min("e").alias("e")), "bars")
    chosen = best.select("e").distinct()
    up = best.select(F.col("part").alias("_p"), F.col("up").alias("_u"))
    # The smaller of a pair that points at each other is a root.
    point = best.select("part", "up").join(up, F.col("up") == F.col("_p")).select("part", F.when((F.col("_u") == F.col("part")) & (F.col("part") < F.col("up")), F.col("part")).otherwise(F.col("up")).alias("up"))
    while True:
        point = saved(point, "roots")
        ahead = point.join(point.select(F.col("part").alias("_p"), F.col("up").alias("_u")), F.col("up") == F.col("_p"))
        if ahead.where("_u <> up").isEmpty():
            break
        point = ahead.select("part", F.col("_u").alias("up"))
    root = lambda side: point.select(F.col("part").alias(side), F.col("up").alias(f"root_{side}"))
    left = parts.join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b")
    return chosen, saved(left.groupBy(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).agg(F.min("e").alias("e")), "bars")


def component_barcode(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(frame, birth, death) of dimension 0: a bar per edge of the minimum spanning forest of edges, all frames at once.

    Rounds of forest_round(): edges shrink with the parts, at least by half the parts a round, and each round is written to the
    shared folder. Repeated edges count once; edges of a point with itself, and those with points that aren't there, are no bars.
    """
    known = points.select(F.col("spot_id").alias("_k"))
    edges = edges.where("a <> b").join(known, F.col("a") == F.col("_k"), "left_semi").join(known, F.col("b") == F.col("_k"), "left_semi")
    parts = saved(edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("distance", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "frame")).alias("e")), "bars")
    out = None
    while not parts.isEmpty():
        chosen, parts = forest_round(parts)
        out = chosen if out is None else out.unionByName(chosen)
    out = parts.select("e") if out is None else out
    return out.select("e.frame", F.lit(0.0).alias("birth"), F.col("e.distance").alias("death"))


def barcodes(points: DataFrame, scale: float, **options) -> DataFrame:
    """component_barcode() of points and their edges within a scale: points at one place, which are joined first, at 0, go through the rounds as one."""
    at = by_shuffle(saved(places(points), "places"))
    others = points.join(at.select("spot_id"), "spot_id", "left_anti").where(F.lit(scale >= 0))
    return component_barcode(at, rips_edges(at, scale, **options)).unionByName(others.select("frame", F.lit(0.0).alias("birth"), F.lit(0.0).alias("death")))


def directed(edges: DataFrame, by: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(by, u, v, to): edges (by, a, b), each from the end with fewer edges to the one with more (ties by id); `to` is v's place in that order.

    carry names a column of a and one of b, which come along as nu and nv. A point sends out no more than about the root of twice the edges.
    """
    ends = edges.select(*by, F.explode(F.array("a", "b")).alias("p")).groupBy(*by, "p").agg(F.count("*").alias("d"))
    side = lambda x: ends.select(*by, F.col("p").alias(x), F.struct("d", "p").alias(f"_{x}"))
    both = edges.select(*by, "a", "b", *carry).join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"])
    low = F.col("_a") < F.col("_b")
    one, other = (lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))), (lambda x, y: F.when(low, F.col(y)).otherwise(F.col(x)))
    return both.select(*by, one("a", "b").alias("u"), other("a", "b").alias("v"), F.greatest("_a", "_b").alias("to"), *([one(*carry).alias("nu"), other(*carry).alias("nv")] if carry else []))


def wedges(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, u, v, w): pairs of edges (by, a, b) that go out of one point (directed()).

    Wedges are bounded by edges to the power of 1.5, and a crowded point, whose edges come in, is no hot key.
    """
    out = saved(directed(edges, by).drop("to"), "directed")
    return out.join(out.withColumnRenamed("v", "w"), [*by, "u"]).where("v < w")


def triangles(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, triangles) of edges (by, a, b, na, nb), each once, whose ends stand for na and nb points: wedges that an edge closes, each counted as often as its points' product.

    What follows an edge's end among those that its start goes to leaves as one list, not a row a wedge, and meets the list of what that end
    goes to; lists are by the number that their points stand for.
    """
    out = directed(edges, by, ["na", "nb"])
    held = saved(out.groupBy(*by, "u", "nu").agg(F.sort_array(F.collect_list(F.struct("to", "v", "nv"))).alias("goes")), "directed")
    rest = F.expr("slice(goes, i + 2, size(goes))")
    after = held.select(*by, "nu", "goes", F.posexplode("goes").alias("i", "x")).where("i + 1 < size(goes)").select(*by, F.col("x.v").alias("v"), (F.col("nu") * F.col("x.nv")).alias("n"), rest.alias("goes"))
    lists = lambda df, *more: df.select(*by, "v", "goes", *more, F.explode(F.array_distinct(F.transform("goes", lambda x: x["nv"]))).alias("k"))
    of = lambda name: F.transform(F.filter("goes", lambda x: x["nv"] == F.col("k")), lambda x: x["v"]).alias(name)
    a, b = lists(after, "n").select(*by, "v", "k", "n", of("w")), lists(held.withColumnRenamed("u", "v")).select(*by, "v", "k", of("closed"))
    met = a.join(by_shuffle(b), [*by, "v", "k"])
    return met.groupBy(*by).agg(F.sum(F.col("n") * F.col("k") * F.size(F.array_intersect("w", "closed"))).alias("triangles"))


def simplex_counts(points: DataFrame, edges: DataFrame, scales: Sequence[float]) -> DataFrame:
    """(frame, scale, vertices, edges, triangles, euler) of the complex at each scale: edges a < b, each once; triangles are wedges that an edge closes.

    Points with a column n (places()) stand for n points at one place: each is within any scale of the others there.
    """
    at, many = F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("scale"), "n" in points.columns
    e = edges.select("frame", "a", "b", "distance", at).where("distance <= scale").withColumns({"na": F.lit(1).cast("long"), "nb": F.lit(1).cast("long")})
    if many:
        n = lambda x: points.select(F.col("spot_id").alias(x), F.col("n").alias(f"n{x}"))
        e = e.drop("na", "nb").join(n("a"), "a").join(n("b"), "b")
    e = saved(e, "at-scales")
    two = lambda n: F.col(n) * (F.col(n) - 1) / 2
    whole = lambda x: F.sum(x).cast("long")
    lines = e.groupBy("frame", "scale").agg(whole(F.col("na") * F.col("nb")).alias("edges"), whole(two("na") * F.col("nb") + F.col("na") * two("nb")).alias("_flat"))
    n = F.col("n") if many else F.lit(1)
    near = points.select("frame", n.alias("n"), at).withColumn("n_", F.when(F.col("scale") >= 0, F.col("n")).otherwise(F.lit(0)))
    counts = near.groupBy("frame", "scale").agg(F.sum("n").alias("vertices"), whole(two("n_")).alias("_edges"), whole(two("n_") * (F.col("n_") - 2) / 3).alias("_triangles"))
    out = counts.join(lines, ["frame", "scale"], "left").join(triangles(e, ["frame", "scale"]), ["frame", "scale"], "left").na.fill(0, ["edges", "triangles", "_flat"])
    out = out.select("frame", "scale", "vertices", (F.col("edges") + F.col("_edges")).alias("edges"), (F.col("triangles") + F.col("_flat") + F.col("_triangles")).alias("triangles"))
    return out.withColumn("euler", F.col("vertices") - F.col("edges") + F.col("triangles"))


def persistence_stats(bars: DataFrame, longest: int = 5, bin_frames: int = 50) -> DataFrame:
    """The longest bars of each frame, with their persistence and time bin."""
    rows = bars.withColumn("persistence", F.col("death") - F.col("birth")).withColumn("bin", F.floor(F.col("frame") / bin_frames))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("persistence"), "death"))).where(F.col("rank") <= longest)
