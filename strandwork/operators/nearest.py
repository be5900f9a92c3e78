"""Nearest points by descent through a pyramid of cells: exact at any density and distance, without meeting whole frames.

Points are put into cells, cells into cells FACTOR times as wide, up to a few per frame; each cell knows its points' number and
bounds. A query starts with the widest cells of its frame. At each level it knows a distance within which it surely has
its k points (from the farthest corners of its cells' bounds), drops the cells that begin beyond that, and goes on with the cells inside
the others. So a query meets a few cells a level, however many points its frame has and however far they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import by_shuffle, saved

#: Cells along each axis of a wider cell.
FACTOR = 4
#: Levels from the top whose cells are few a frame (at most FACTOR^3 times as many each); those below grow with the points, and go by shuffle.
WIDE = 2
#: Part of a bound by which cells beyond it are kept still: sums of squares in another order differ in the last bits.
SLACK = 1e-9


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def pyramid(points: DataFrame, axes: Sequence[str], width: float, levels: int, frame: str = "frame") -> list[DataFrame]:
    """Cells by level, the narrowest (of `width`) first: (_f, _<axis> cell numbers, low_<axis>, high_<axis>, n). Each is an aggregate of the one before."""
    cells = [F.floor(F.col(c) / width).alias(f"_{c}") for c in axes]
    ends = [x for c in axes for x in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))]
    out = [saved(points.groupBy(F.col(frame).alias("_f"), *cells).agg(F.count("*").alias("n"), *ends), "cells")]
    ends = [x for c in axes for x in (F.min(f"low_{c}").alias(f"low_{c}"), F.max(f"high_{c}").alias(f"high_{c}"))]
    for _ in range(levels):
        wider = [F.expr(f"floor(_{c} / {FACTOR})").alias(f"_{c}") for c in axes]
        out.append(saved(out[-1].groupBy("_f", *wider).agg(F.sum("n").alias("n"), *ends), "cells"))
    return out


def nearest(queries: DataFrame, points: DataFrame, k: int, key: str, point_key: str, axes: Sequence[str], frame: str = "frame", carry: Sequence[str] = (), radius: float | None = None, offset: str | None = None) -> DataFrame:
    """(q_key, p_point_key, rank, distance, p_carry): the k nearest points of the query's frame, by distance then point_key; all of them if the frame has fewer.

    Null places are no one's neighbours and have none; queries of frames without points give no rows. Keys of queries are
    taken to be unique. The depth of the pyramid follows from the number of points: each level is one aggregate by query and
    one equi-join on cells. Queries at one place descend as one, and of points at one place only the k first can be
    among the nearest, so copies of either cost no more than their own rows.

    carry names columns of points that come along; radius leaves out what is farther. offset names a column of queries that is added to
    distances where they are ordered: for k = 1 only, so that offsets in which distances round to one sum tie.
    """
    there = [F.col(c).isNotNull() & ~F.isnan(c) for c in axes]
    place = ["_f", *[f"q_{c}" for c in axes], *(["_o"] if offset else [])]
    points = points.where(reduce(lambda a, b: a & b, there)).select(F.struct(F.col(point_key).alias("_key"), *carry).alias("_pk"), frame, *[F.col(c).cast("double").alias(c) for c in axes])
    asked = queries.where(reduce(lambda a, b: a & b, there)).select(F.col(key).alias("_qk"), F.col(frame).alias("_f"), *[F.col(c).cast("double").alias(f"q_{c}") for c in axes], *([F.col(offset).alias("_o")] if offset else []))
    if k == 1:
        points = points.groupBy(frame, *axes).agg(F.min("_pk").alias("_pk"))
    else:
        points = points.withColumn("_r", F.row_number().over(Window.partitionBy(frame, *axes).orderBy("_pk"))).where(F.col("_r") <= k).drop("_r")
    points = saved(points, "points")
    span = points.agg(F.count("*").alias("n"), *[F.min(c).alias(f"low_{c}") for c in axes], *[F.max(c).alias(f"high_{c}") for c in axes]).first()
    if not span["n"]:
        none = lambda c, name: F.lit(None).cast(points.schema["_pk"].dataType[c].dataType).alias(name)
        return asked.select(F.col("_qk").alias(f"q_{key}"), none("_key", f"p_{point_key}"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance"), *[none(c, f"p_{c}") for c in carry]).limit(0)
    widest = max(max(span[f"high_{c}"] - span[f"low_{c}"] for c in axes), 1e-9)
    levels = max(1, math.ceil(math.log(span["n"]) / (2 * math.log(FACTOR))))
    width = widest / FACTOR**levels
    cells = pyramid(points, axes, width, levels, frame)

    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(f"q_{c}"), F.col(f"q_{c}") - F.col(f"high_{c}"))
    far = lambda c: F.greatest(F.abs(F.col(f"q_{c}") - F.col(f"low_{c}")), F.abs(F.col(f"q_{c}") - F.col(f"high_{c}")))
    own = Window.partitionBy(*place)
    met = saved(asked.select(*place).distinct(), "places").join(cells[-1], "_f")
    for level in range(levels, -1, -1):
        met = met.withColumns({"_near": _sum([gap(c) * gap(c) for c in axes]), "_far": _sum([far(c) * far(c) for c in axes])})
        if radius is not None:
            met = met.where(F.sqrt("_near") <= radius * (1 + SLACK))
        if k == 1:
            bound = F.min("_far").over(own)
        else:  # the nearest distance within which cells that lie within it have k points; all of the frame's, if it has fewer
            met = met.withColumn("_held", F.sum("n").over(own.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)))
            bound = F.coalesce(F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(own), F.max("_far").over(own))
        slack = SLACK * F.abs("_o") if offset else F.lit(0.0)
        met = met.withColumn("_bound", bound).where(F.sqrt("_near") <= F.sqrt("_bound") * (1 + SLACK) + slack)
        numbers = [f"_{c}" for c in axes]
        met = met.select(*place, *numbers)
        if level:
            below = cells[level - 1].withColumns({f"_up_{c}": F.expr(f"floor(_{c} / {FACTOR})") for c in axes})
            if levels - level >= WIDE:
                below = by_shuffle(below)
            met = met.withColumnsRenamed({f"_{c}": f"_up_{c}" for c in axes}).join(below, ["_f", *[f"_up_{c}" for c in axes]]).drop(*[f"_up_{c}" for c in axes])
    inside = by_shuffle(points).select("_pk", F.col(frame).alias("_f"), *[F.col(c).alias(f"p_{c}") for c in axes], *[F.floor(F.col(c) / width).alias(f"_{c}") for c in axes])
    pairs = met.join(inside, ["_f", *[f"_{c}" for c in axes]]).select(*place, "_pk", F.sqrt(_sum([(F.col(f"q_{c}") - F.col(f"p_{c}")) * (F.col(f"q_{c}") - F.col(f"p_{c}")) for c in axes])).alias("distance"))
    if radius is not None:
        pairs = pairs.where(F.col("distance") <= radius)
    if k == 1:
        order = F.struct((F.col("_o") + F.col("distance") if offset else F.col("distance")).alias("cost"), "_pk", "distance")
        best = pairs.groupBy(*place).agg(F.min(order).alias("b")).select(*place, "b._pk", F.lit(1).alias("rank"), "b.distance")
    else:
        best = pairs.withColumn("rank", F.row_number().over(own.orderBy("distance", "_pk"))).where(F.col("rank") <= k)
    return asked.join(best, place).select(F.col("_qk").alias(f"q_{key}"), F.col("_pk._key").alias(f"p_{point_key}"), "rank", "distance", *[F.col(f"_pk.{c}").alias(f"p_{c}") for c in carry])
