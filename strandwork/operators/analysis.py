"""Ergodicity, comparison of two trackings, votes over windows, fate maps, drift and series statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, lineage, space


def ensemble_average(rows: DataFrame, features: Sequence[str], cell_type: str = "cell_type", key: str = "head") -> DataFrame:
    """(cell_type, frame, features): at each frame, the mean over tracklets of their means."""
    by_piece = rows.where(F.col(cell_type).isNotNull()).groupBy(cell_type, "frame", key).agg(*[F.avg(f).alias(f) for f in features])
    return by_piece.groupBy(cell_type, "frame").agg(*[F.avg(f).alias(f) for f in features])


def time_average(rows: DataFrame, features: Sequence[str], delta: int, cell_type: str = "cell_type", key: str = "head") -> DataFrame:
    """(cell_type, start, features): over frames start .. start + delta, each tracklet's mean, then the mean over tracklets; starts up to the last frame less delta."""
    last = rows.agg(F.max("frame").alias("last"))
    spread = rows.where(F.col(cell_type).isNotNull()).withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("frame") - delta), F.col("frame"))))
    spread = spread.join(F.broadcast(last), F.lit(True)).where(F.col("start") <= F.col("last") - delta)
    by_piece = spread.groupBy(cell_type, "start", key).agg(*[F.avg(f).alias(f) for f in features])
    return by_piece.groupBy(cell_type, "start").agg(*[F.avg(f).alias(f) for f in features])


def ergodicity_gap(rows: DataFrame, features: Sequence[str], delta: int, cell_type: str = "cell_type", key: str = "head") -> DataFrame:
    """(cell_type, end_frame, gap per feature): absolute difference of the ensemble average at the end and the time average up to it."""
    t = time_average(rows, features, delta, cell_type, key).select(cell_type, (F.col("start") + delta).alias("end_frame"), *[F.col(f).alias(f"_{f}") for f in features])
    e = ensemble_average(rows, features, cell_type, key).withColumnRenamed("frame", "end_frame")
    return e.join(t, [cell_type, "end_frame"]).select(cell_type, "end_frame", *[F.abs(F.col(f) - F.col(f"_{f}")).alias(f"{f}_gap") for f in features])


def alike(spots: DataFrame) -> DataFrame:
    """(track_id, cloud): tracks with the same points in the same frames, copies counted, have one cloud, named by the smallest track_id.

    Points are told apart by their number and two sums of 64-bit hashes, so that no track is held in one place.
    """
    at = [F.col("frame"), *[F.col(c) for c in space.AXES], *[F.col(c).isNull() for c in ("frame", *space.AXES)]]
    sums = [F.sum(F.xxhash64(F.lit(seed), *at).cast("decimal(20,0)")).alias(f"_{seed}") for seed in (1, 2)]
    tracks = spots.where("track_id is not null").groupBy("track_id").agg(F.count("*").alias("_n"), *sums)
    return tracks.select("track_id", F.min("track_id").over(Window.partitionBy("_n", "_1", "_2")).alias("cloud"))


def cloud_costs(truth: DataFrame, found: DataFrame, gate: float) -> DataFrame:
    """cloud_distance() of the tracks as they are, each with each."""
    pairs = space.within(truth.select("spot_id", "track_id", "frame", *space.AXES), found.select("spot_id", "track_id", "frame", *space.AXES), gate)
    sizes = lambda df, k: df.groupBy(F.col("track_id").alias(k)).agg(F.count("*").alias(f"{k}_n"))
    near = lambda side, name: pairs.groupBy("q_track_id", "p_track_id", f"{side}_spot_id").agg(F.round(F.min("distance") * 1e9).cast("long").alias("d")).groupBy("q_track_id", "p_track_id").agg((F.sum("d") / 1e9).alias(f"{name}_sum"), F.count("*").alias(f"{name}_hit"))
    both = near("q", "a").join(near("p", "b"), ["q_track_id", "p_track_id"]).join(sizes(truth, "q_track_id"), "q_track_id").join(sizes(found, "p_track_id"), "p_track_id")
    mean = lambda n, k: (F.col(f"{n}_sum") + (F.col(f"{k}_n") - F.col(f"{n}_hit")) * gate) / F.col(f"{k}_n")
    return both.select(F.col("q_track_id").alias("track_id"), F.col("p_track_id").alias("other_id"), F.greatest(mean("a", "q_track_id"), mean("b", "p_track_id")).alias("cost"))


def cloud_distances(truth: DataFrame, found: DataFrame, gate: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(costs, tracks, others): cloud_distance() between clouds, of equal tracks only the one that names theirs, and the clouds (alike()) of both trackings' tracks."""
    tracks, others = (lineage.by_shuffle(lineage.saved(alike(df), "clouds")) for df in (truth, found))
    one = lambda df, clouds: df.join(clouds.where("track_id = cloud").select("track_id"), "track_id", "left_semi")
    return cloud_costs(one(truth, tracks), one(found, others), gate), tracks, others


def cloud_distance(truth: DataFrame, found: DataFrame, gate: float) -> DataFrame:
    """(track_id, other_id, cost) of tracks with points within gate in one frame: the larger of the two mean nearest-point distances, points without a partner counting the gate.

    Nearest distances are added up in whole units of 1e-9, so that a cost does not depend on the order of its rows. Equal tracks have
    equal costs, so only clouds meet; each pair of them gives a row for each pair of its tracks.
    """
    costs, tracks, others = cloud_distances(truth, found, gate)
    costs = costs.withColumnsRenamed({"track_id": "cloud", "other_id": "_other"}).join(tracks, "cloud").drop("cloud")
    return costs.join(others.select(F.col("cloud").alias("_other"), F.col("track_id").alias("other_id")), "_other").select("track_id", "other_id", "cost")


def mutual_nearest(costs: DataFrame) -> DataFrame:
    """One round of assignment: pairs that are each other's cheapest, ties by the smaller ids."""
    a = Window.partitionBy("track_id").orderBy("cost", "other_id")
    b = Window.partitionBy("other_id").orderBy("cost", "track_id")
    ranked = costs.withColumns({"_a": F.row_number().over(a), "_b": F.row_number().over(b)})
    return ranked.where("_a = 1 and _b = 1").select("track_id", "other_id", "cost")


def assign_tracks(costs: DataFrame, threshold: float) -> DataFrame:
    """(track_id, other_id, cost, matched): one to one, greedy: rounds of mutual nearest pairs; total cost can exceed the optimum's."""
    left, out = lineage.saved(costs, "costs"), None
    while not left.isEmpty():
        new = lineage.saved(mutual_nearest(left), "assigned")
        out = new if out is None else out.unionByName(new)
        left = lineage.saved(left.join(new.select("track_id"), "track_id", "left_anti").join(new.select("other_id"), "other_id", "left_anti"), "costs")
    out = costs.limit(0) if out is None else out
    return out.withColumn("matched", F.col("cost") <= threshold)


def assign_alike(costs: DataFrame, tracks: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """assign_tracks() of all tracks, from the costs between their clouds (cloud_distances()).

    A cloud stands for its tracks by id. In a round, clouds that are each other's cheapest give each other the tracks that are left, as many as both
    have; where one of them has another cloud at the same cost, ties go by ids, so that only the first track of each is given.
    """
    order = Window.partitionBy("cloud")
    members = [lineage.by_shuffle(lineage.saved(df.select("cloud", "track_id", F.row_number().over(order.orderBy("track_id")).cast("long").alias("rank"), F.count("*").over(order).alias("n")), "members")) for df in (tracks, others)]
    sides = (("track_id", "a"), ("other_id", "b"))
    left = costs
    for (key, x), m in zip(sides, members):
        left = left.join(m.where("rank = 1").select(F.col("cloud").alias(key), F.col("track_id").alias(f"{x}_first"), F.lit(0).cast("long").alias(f"{x}_used"), F.col("n").alias(f"{x}_n")), key)
    left, out = lineage.saved(left, "costs"), None
    while not left.isEmpty():
        a, b = Window.partitionBy("track_id").orderBy("cost", "b_first"), Window.partitionBy("other_id").orderBy("cost", "a_first")
        ranked = left.withColumns({f"_{x}": F.row_number().over(w) for x, w in (("a", a), ("b", b))} | {f"_{x}_next": F.lead("cost").over(w) for x, w in (("a", a), ("b", b))})
        alone = F.coalesce(F.col("_a_next") > F.col("cost"), F.lit(True)) & F.coalesce(F.col("_b_next") > F.col("cost"), F.lit(True))
        given = F.when(alone, F.least(F.expr("a_n - a_used"), F.expr("b_n - b_used"))).otherwise(F.lit(1).cast("long"))
        new = lineage.saved(ranked.where("_a = 1 and _b = 1").select("track_id", "other_id", "cost", "a_used", "b_used", given.alias("given")), "assigned")
        out = new if out is None else out.unionByName(new)
        for (key, x), m in zip(sides, members):
            first = m.select(F.col("cloud").alias(key), (F.col("rank") - 1).alias("_at"), F.col("track_id").alias("_first"))
            moved = new.select(key, (F.col(f"{x}_used") + F.col("given")).alias("_at")).join(first, [key, "_at"], "left")
            left = left.join(moved, key, "left").where("_at is null or _first is not null")  # a cloud whose tracks are all given has no first
            left = left.withColumns({f"{x}_used": F.coalesce("_at", f"{x}_used"), f"{x}_first": F.coalesce("_first", f"{x}_first")}).drop("_at", "_first")
        left = lineage.saved(left, "costs")
    if out is None:
        return costs.limit(0).withColumn("matched", F.col("cost") <= threshold)
    a, b = (m.select(F.col("cloud").alias(f"_{x}"), F.col("track_id").alias(key), F.col("rank").alias(f"{x}_rank")) for (key, x), m in zip(sides, members))
    out = out.withColumnsRenamed({"track_id": "_a", "other_id": "_b"}).join(a, "_a").where("a_rank > a_used and a_rank <= a_used + given")
    out = out.withColumn("b_rank", F.expr("a_rank - a_used + b_used")).join(b, ["_b", "b_rank"])
    return out.select("track_id", "other_id", "cost", (F.col("cost") <= threshold).alias("matched"))


def hits(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.count_if("matched").alias("matched"), F.count("*").alias("assigned"), F.sum("cost").alias("total_cost"))


def cycle_accuracy(lives: DataFrame, other: DataFrame, factor: int = 1) -> DataFrame:
    """(accuracy): 1 less the largest gap of the two cumulative histograms of life lengths; other's lengths times factor."""
    a, b = lives.select("life", F.lit(1).alias("a"), F.lit(0).alias("b")), other.select((F.col("life") * factor).alias("life"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    counts = a.unionByName(b).groupBy("life").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = Window.orderBy("life").rowsBetween(Window.unboundedPreceding, 0)
    whole = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))  # lengths are few: one row per length
    gaps = counts.withColumns({"ca": F.sum("a").over(run), "cb": F.sum("b").over(run)}).join(F.broadcast(whole), F.lit(True))
    return gaps.agg((1 - F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb")))).alias("accuracy"))


def complete_tracks(assigned: DataFrame, spans: DataFrame, others: DataFrame, factor: int = 1) -> DataFrame:
    """(complete): twice the assigned pairs with equal first and last frame over all tracks of both; spans are (track_id, start, stop); others' frames times factor."""
    others = others.withColumns({c: F.col(c) * factor for c in ("start", "stop")})
    pairs = assigned.join(spans, "track_id").join(others.select(F.col("track_id").alias("other_id"), F.col("start").alias("s2"), F.col("stop").alias("e2")), "other_id")
    n = pairs.agg(F.count_if((F.col("start") == F.col("s2")) & (F.col("stop") == F.col("e2"))).alias("n"))
    return n.join(spans.agg(F.count("*").alias("na")), F.lit(True)).join(others.agg(F.count("*").alias("nb")), F.lit(True)).select((2 * F.col("n") / (F.col("na") + F.col("nb"))).alias("complete"))


def division_events(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(track_id, frame, spot_id) of every split."""
    return lineage.splits(edges).join(spots.select("spot_id", "frame"), "spot_id").select("track_id", "frame", "spot_id")


def branching_f1(truth: DataFrame, found: DataFrame, assigned: DataFrame, tolerance: int = 1) -> DataFrame:
    """(f1): of all division events; one is met if the track matched with its own (assign_tracks()) has one within tolerance frames. Those of tracks without a match are not met."""
    pairs = assigned.where("matched").select("track_id", "other_id")
    t, f = truth.join(pairs, "track_id").select("track_id", "frame", F.col("spot_id").alias("a")), found.select(F.col("track_id").alias("other_id"), F.col("frame").alias("g"), F.col("spot_id").alias("b")).join(pairs, "other_id")
    near = t.join(f, "track_id").where(F.abs(F.col("frame") - F.col("g")) <= tolerance)
    counts = near.agg(F.countDistinct("a").alias("ta"), F.countDistinct("b").alias("tb"))
    n = counts.join(truth.agg(F.count("*").alias("na")), F.lit(True)).join(found.agg(F.count("*").alias("nb")), F.lit(True))
    recall, precision = F.col("ta") / F.nullif("na", F.lit(0)), F.col("tb") / F.nullif("nb", F.lit(0))
    return n.select(F.coalesce(2 * recall * precision / F.nullif(recall + precision, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def majority_vote(predictions: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label): the most frequent label, ties by the smaller; null if there is none."""
    counts = predictions.groupBy(key, label).agg(F.count(label).alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), F.col(label).asc_nulls_last())
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, label)


def weighted_vote(predictions: DataFrame, key: str, label: str, weight: str, none: str = "UnClassified") -> DataFrame:
    """(key, label): the label with the largest summed weight, ties by the smaller; `none` without a label."""
    sums = predictions.groupBy(key, label).agg(F.sum(F.when(F.col(label).isNotNull(), F.col(weight))).alias("w"))
    best = Window.partitionBy(key).orderBy(F.col("w").desc_nulls_last(), F.col(label).asc_nulls_last())
    return sums.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, F.coalesce(label, F.lit(none)).alias(label))


def transitions(spots: DataFrame, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(source_id, t, from_*, to_*): positions of linked spots in consecutive frames, from the earlier to the later one; in reverse from the later, at t, to the earlier."""
    first, second = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    at = spots.select("spot_id", "frame", *space.AXES)
    a = at.select(F.col("spot_id").alias(first), F.col("frame").alias("t"), *[F.col(c).alias(f"from_{c}") for c in space.AXES])
    b = at.select(F.col("spot_id").alias(second), F.col("frame").alias("u"), *[F.col(c).alias(f"to_{c}") for c in space.AXES])
    moved = edges.join(a, first).join(b, second).where(F.col("u") == F.col("t") + (-1 if reverse else 1))
    return moved.select(F.col(first).alias("source_id"), "t", *[f"{d}_{c}" for d in ("from", "to") for c in space.AXES])


def fill_transitions(spots: DataFrame, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """transitions() and, for spots that end before the last frame (in reverse: begin after the first), the nearest spot of the next (the one before)."""
    linked = transitions(spots, edges, reverse)
    ended = spots.select("spot_id", "frame", *space.AXES).join(linked.select(F.col("source_id").alias("spot_id")), "spot_id", "left_anti")
    ahead = space.knn(ended.withColumn("frame", F.col("frame") + (-1 if reverse else 1)), spots.select("spot_id", "frame", *space.AXES), 1, "spot_id")
    to = spots.select(F.col("spot_id").alias("p_spot_id"), *[F.col(c).alias(f"to_{c}") for c in space.AXES])
    more = ahead.select(F.col("q_spot_id").alias("source_id"), "p_spot_id").join(to, "p_spot_id").join(ended.select(F.col("spot_id").alias("source_id"), F.col("frame").alias("t"), *[F.col(c).alias(f"from_{c}") for c in space.AXES]), "source_id")
    return linked.unionByName(more.select(*linked.columns))


def places_of(moves: DataFrame) -> DataFrame:
    """(frame, z, y, x, n, to_*): moves from one place as one, with their number and the sums of their targets."""
    return moves.groupBy(F.col("t").alias("frame"), *[F.col(f"from_{c}").alias(c) for c in space.AXES]).agg(F.count("*").alias("n"), *[F.sum(f"to_{c}").alias(f"to_{c}") for c in space.AXES])


def radius_predict(queries: DataFrame, moves: DataFrame, radius: float, weight: Column | None = None, key: str = "id") -> DataFrame:
    """(key, z, y, x): weighted mean of the targets of sources within radius in the query's frame; null without any.

    Weights are 1 / distance (1e10 at 0) unless an expression over `distance` is given. Queries at one place ask once, and sources at
    one place, which weigh the same, are met as one.
    """
    return predict(queries, places_of(moves), radius, weight, key)


def predict(queries: DataFrame, places: DataFrame, radius: float, weight: Column | None = None, key: str = "id") -> DataFrame:
    """radius_predict() from places_of() moves."""
    weight = F.when(F.col("distance") == 0, F.lit(1e10)).otherwise(1 / F.nullif("distance", F.lit(0.0))) if weight is None else weight
    asked = queries.select("frame", *space.AXES).distinct()
    near = space.within(asked, places, radius).withColumn("w", weight)
    at = [f"q_{c}" for c in ("frame", *space.AXES)]
    means = near.groupBy(*at).agg(*[(F.sum(F.col("w") * F.col(f"p_to_{c}")) / F.sum(F.col("w") * F.col("p_n"))).alias(c) for c in space.AXES])
    there = queries.select(key, *[F.col(c).alias(f"q_{c}") for c in ("frame", *space.AXES)])
    return there.join(means, at, "left").select(key, *space.AXES)


def follow(sources: DataFrame, moves: DataFrame, radius: float, steps: int, key: str = "id", reverse: bool = False) -> DataFrame:
    """(key, frame, z, y, x): paths of sources by repeated prediction, frame by frame (in reverse, by reversed moves, back in time); a path ends where it has no neighbours.

    Places of the moves are made once, for all steps.
    """
    at, places = lineage.saved(sources.select(key, "frame", *space.AXES), "path"), lineage.saved(places_of(moves), "moves")
    out = at
    for _ in range(steps):
        ahead = predict(at, places, radius, None, key).where("z is not null")
        at = lineage.saved(ahead.join(at.select(key, (F.col("frame") + (-1 if reverse else 1)).alias("frame")), key).select(key, "frame", *space.AXES), "path")
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out


def track_clouds(spots: DataFrame) -> DataFrame:
    """(track_id, n, frame, z, y, x): each track's points, with the number of them."""
    sizes = spots.groupBy("track_id").agg(F.count("*").alias("n"))
    return spots.select("track_id", "frame", *space.AXES).join(sizes, "track_id")


def downsample_time(spots: DataFrame, factor: int) -> DataFrame:
    """spots with their frames times factor: a tracking of every factor-th frame set beside one of all."""
    return spots.withColumn("frame", F.col("frame") * factor)


def xy_drift(steps: DataFrame, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """(frame, drift per axis): the median step of linked spots into each frame, added up from the first frame's 0.

    Medians are exact and found by ranks over range partitions, so that a frame of any size is many tasks' work.
    """
    shift = None
    for c in axes:
        one = blocks.quantiles(steps.select(F.col("to_frame").alias("frame"), f"d{c}"), ["frame"], f"d{c}", {f"_{c}": 0.5})
        shift = one if shift is None else shift.join(one, "frame")
    run = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)  # one row per frame
    first = steps.agg(F.min("from_frame").alias("frame")).select("frame", *[F.lit(0.0).alias(f"_{c}") for c in axes])
    return shift.unionByName(first).select("frame", *[F.sum(f"_{c}").over(run).alias(f"drift_{c}") for c in axes])


def rotation_drift(steps: DataFrame, spots: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """(frame, rotation): radians about the centre (y, x) from frame to frame, added up."""
    cy, cx = centre
    a = steps.join(spots.select(F.col("spot_id").alias("target_id"), "y", "x"), "target_id")
    y0, x0, y1, x1 = F.col("y") - F.col("dy") - cy, F.col("x") - F.col("dx") - cx, F.col("y") - cy, F.col("x") - cx
    turn = a.groupBy(F.col("to_frame").alias("frame")).agg(F.atan2(F.sum(x0 * y1 - y0 * x1), F.sum(x0 * x1 + y0 * y1)).alias("_r"))
    return turn.select("frame", F.sum("_r").over(Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)).alias("rotation"))


def apply_translation(spots: DataFrame, drift: DataFrame, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """spots with each frame's drift taken off; frames without one stay."""
    return spots.join(F.broadcast(drift), "frame", "left").withColumns({c: F.col(c) - F.coalesce(f"drift_{c}", F.lit(0.0)) for c in axes}).drop(*[f"drift_{c}" for c in axes])


def apply_rotation(spots: DataFrame, rotation: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """spots turned back about the centre (y, x) by each frame's rotation."""
    cy, cx = centre
    r = -F.coalesce("rotation", F.lit(0.0))
    dy, dx = F.col("y") - cy, F.col("x") - cx
    return spots.join(F.broadcast(rotation), "frame", "left").withColumns({"y": F.sin(r) * dx + F.cos(r) * dy + cy, "x": F.cos(r) * dx - F.sin(r) * dy + cx}).drop("rotation")


def crop_common(spots: DataFrame, drift: DataFrame, size: tuple[float, float]) -> DataFrame:
    """Spots (already shifted) within the area (y, x) that is valid in every frame; its bounds count to 9 places, so that a sum's last bit moves no spot out."""
    ends = drift.agg(*[f(f"drift_{c}").alias(f"{n}_{c}") for c in ("y", "x") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    df = spots.join(F.broadcast(ends), F.lit(True))
    for c, s in zip(("y", "x"), size):
        low, high = F.round(F.greatest(F.lit(0.0), -F.col(f"lo_{c}")), 9), F.round(s - F.greatest(F.lit(0.0), F.col(f"hi_{c}")), 9)
        df = df.where((F.col(c) >= low) & (F.col(c) <= high))
    return df.drop("lo_y", "hi_y", "lo_x", "hi_x")


def autocorrelation(series: DataFrame, lags: int, key: str = "head") -> DataFrame:
    """(key, lag, acf) over series (key, i, value): normalised, lags 0 .. min(lags, n - 1); null for a constant series.

    What stands lag places on comes from windows over a key's rows, so that all lags take one shuffle by key.
    """
    own = Window.partitionBy(key)
    d = series.where(F.col(key).isNotNull()).select(key, "i", F.count("*").over(own).alias("n"), (F.col("value") - F.avg("value").over(own)).alias("d"))
    on = lambda k: own.orderBy("i").rangeBetween(k, k)
    later = [F.struct(F.lit(k).alias("lag"), F.sum("d").over(on(k)).alias("d"), F.count("i").over(on(k)).alias("met")) for k in range(lags + 1)]
    rows = d.withColumn("_later", F.array(*later)).select(key, "i", "n", "d", F.explode("_later").alias("p"))
    there = F.col("i").isNotNull() & (F.col("p.lag") < F.col("n"))
    sums = rows.groupBy(key, F.col("p.lag").alias("lag")).agg(F.sum(F.when(there, F.col("d") * F.col("p.d"))).alias("c"), F.sum(F.when(F.col("p.lag") == 0, F.col("d") * F.col("d"))).alias("s"), F.count_if(there & (F.col("p.met") > 0)).alias("met"))
    total = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(own)
    return sums.withColumn("_s", total).where("met > 0").select(key, "lag", (F.col("c") / F.nullif("_s", F.lit(0.0))).alias("acf"))


def pooled_normal_fit(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, mean, std): mean and population deviation of the pool."""
    return values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
