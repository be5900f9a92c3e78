"""Queries of series statistics and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import tracklets as T
from .catalog_analysis import FULL, ON, full
from .registry import register

speed = lambda v: T.numbered(full(v)).select("head", "i", F.col("speed").alias("value"))
register("polynomial_trend", lambda v: S.polynomial_trend(speed(v), 6).select("head", "i", "fitted"))
register("linear_trend", lambda v: S.linear_trend(speed(v)), ON, f"SELECT head, regr_slope(speed, CAST(i AS DOUBLE)) AS slope, regr_intercept(speed, CAST(i AS DOUBLE)) AS intercept FROM {FULL} GROUP BY 1", "slope intercept")
NORM = f"(SELECT head, i, n, (speed - avg(speed) OVER w) / nullif(stddev_pop(speed) OVER w, 0) AS f0, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS f1, (y - avg(y) OVER w) / nullif(stddev_pop(y) OVER w, 0) AS f2 FROM {FULL} WINDOW w AS (PARTITION BY head))"
PAIRS = [("speed", 0, 1), ("speed", 0, 2), ("x", 1, 0), ("x", 1, 2), ("y", 2, 0), ("y", 2, 1)]
CCF = " UNION ALL ".join(f"SELECT a.head, '{f}' AS feature, lag, sum(a.f{p} * b.f{q}) / (any_value(a.n) - lag) AS c FROM {NORM} a JOIN range(0, 4) r(lag) ON lag < a.n JOIN {NORM} b ON b.head = a.head AND b.i = a.i + lag GROUP BY 1, 2, 3" for f, p, q in PAIRS)
register("cross_correlation", lambda v: S.cross_correlation(T.numbered(full(v)).select("head", "i", "speed", "x", "y"), ["speed", "x", "y"], 3).withColumn("lag", F.col("lag").cast("long")), ON, f"SELECT head, feature, lag, avg(c) AS ccf FROM ({CCF}) WHERE c IS NOT NULL GROUP BY 1, 2, 3", "ccf")
register("anderson_darling", lambda v: S.anderson_darling(full(v).withColumn("later", F.col("generation") > 0), ["later"], "speed"))
lives = lambda v: v.pieces.select("spot_id", "head").join(v.spots.select("spot_id", "frame"), "spot_id").groupBy("head").agg((F.max("frame") - F.min("frame")).alias("life"))
register("generation_report", lambda v: S.generation_report(full(v), lives(v), ["speed", "x"]))
register("generation_report_of_type", lambda v: S.generation_report(full(v), lives(v), ["speed", "acceleration"], cell_type="Basal"))
register("by_duration", lambda v: S.by_duration(v.pieces.select("spot_id", "head"), lives(v)), ON, f"SELECT spot_id, head, place FROM {FULL} JOIN (SELECT head, row_number() OVER (ORDER BY max(frame) - min(frame) DESC, head) AS place FROM {FULL} GROUP BY 1) USING (head)")
register("score_windows", lambda v: S.score_windows(full(v), ["speed", "x"], 3, lambda w: (w[:, :, 0].mean(axis=1) > 30).astype(int)), ON,
         f"SELECT a.head, a.i AS start, CASE WHEN (a.speed + b.speed + c.speed) / 3 > 30 THEN '1' ELSE '0' END AS label FROM {FULL} a JOIN {FULL} b ON b.head = a.head AND b.i = a.i + 1 JOIN {FULL} c ON c.head = a.head AND c.i = a.i + 2")
register("sample_sources", lambda v: S.sample_sources(v.annotations.select(F.col("ann_id").alias("id"), F.col("t").alias("frame"), "z", "y", "x"), v.spots, 2), "annotations spots",
         """SELECT id, frame, z, y, x FROM (SELECT a.ann_id AS id, b.frame, b.z, b.y, b.x, row_number() OVER (PARTITION BY a.ann_id ORDER BY sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), b.spot_id) AS r FROM annotations a JOIN spots b ON b.frame = a.t) WHERE r <= 2""", "z y x")  # fmt: skip
register("copy_sources", lambda v: S.sample_sources(v.annotations.select(F.col("ann_id").alias("id"), F.col("t").alias("frame"), "z", "y", "x"), v.spots, 2, False), "annotations", "SELECT ann_id AS id, t AS frame, z, y, x FROM annotations, range(0, 2)", "z y x")
register("as_tracks", lambda v: S.as_tracks(v.annotations.select(F.col("ann_id").alias("id"), F.col("t").alias("frame"), "x")), "annotations", "SELECT ann_id AS id, t AS frame, x, row_number() OVER (ORDER BY ann_id) - 1 AS path FROM annotations", "x")
