"""Queries of scalars, lineage and kinematics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import kinematics as K
from ..operators import lineage as L
from .registry import register

ids = lambda df, *c: df.select(*c)

register("track_speeds", lambda v: v.motion.groupBy("track_id").agg(F.avg("speed").alias("mean_speed"), F.max("speed").alias("max_speed")), "motion",
         "SELECT track_id, avg(speed) AS mean_speed, max(speed) AS max_speed FROM motion GROUP BY 1", "mean_speed max_speed")
register("children", lambda v: L.children(v.edges).select("spot_id", F.posexplode("children").alias("n", "child_id")).withColumn("n", F.col("n").cast("long")), "edges",
         "SELECT source_id AS spot_id, row_number() OVER (PARTITION BY source_id ORDER BY target_id) - 1 AS n, target_id AS child_id FROM edges")
register("parents", lambda v: L.parents(v.edges).select("spot_id", F.explode("parents").alias("parent_id")), "edges", "SELECT target_id AS spot_id, source_id AS parent_id FROM edges")
register("roots", lambda v: L.roots(v.edges), "edges", "SELECT DISTINCT track_id, source_id AS spot_id FROM edges WHERE source_id NOT IN (SELECT target_id FROM edges)")
register("leaves", lambda v: L.leaves(v.edges), "edges", "SELECT DISTINCT track_id, target_id AS spot_id FROM edges WHERE target_id NOT IN (SELECT source_id FROM edges)")
register("splits", lambda v: L.splits(v.edges), "edges", "SELECT track_id, source_id AS spot_id FROM edges GROUP BY ALL HAVING count(*) > 1")
register("merges", lambda v: L.merges(v.edges.unionByName(v.edges.where("target_id % 50 = 0").withColumn("source_id", F.col("source_id") + 1))), "edges",
         "SELECT track_id, target_id AS spot_id FROM (FROM edges UNION ALL SELECT track_id, source_id + 1, target_id FROM edges WHERE target_id % 50 = 0) GROUP BY ALL HAVING count(*) > 1")
register("gaps", lambda v: L.gaps(v.edges, v.spots.withColumn("frame", F.col("frame") * (1 + F.col("track_id") % 2))), "edges spots",
         "SELECT e.track_id, source_id, target_id, (b.frame - a.frame) * (1 + e.track_id % 2) AS frames FROM edges e JOIN spots a ON a.spot_id = source_id JOIN spots b ON b.spot_id = target_id WHERE (b.frame - a.frame) * (1 + e.track_id % 2) > 1")
register("splits_with_detections", lambda v: L.splits_with_detections(v.edges, v.detections.where("score > 0.5").select(F.col("det_id").alias("spot_id"))), "edges detections",
         """WITH s AS (SELECT track_id, source_id AS spot_id FROM edges GROUP BY ALL HAVING count(*) > 1), d AS (SELECT det_id FROM detections WHERE score > 0.5)
         FROM s UNION SELECT DISTINCT track_id, source_id FROM edges WHERE source_id IN (FROM d) AND (SELECT count(*) FROM d) > 1""")  # fmt: skip
register("division_label", lambda v: L.division_label(v.spots, v.edges), "spots edges",
         "WITH s AS (SELECT track_id, source_id FROM edges GROUP BY ALL HAVING count(*) > 1) SELECT track_id, count(source_id) AS number_dividing, count(source_id) > 0 AS dividing FROM (SELECT DISTINCT track_id FROM spots) LEFT JOIN s USING (track_id) GROUP BY 1")
register("splits_by_time", lambda v: L.splits_by_time(v.spots, v.edges).select("spot_id", "track_id", "frame"), "spots edges",
         "SELECT spot_id, track_id, frame FROM spots WHERE spot_id IN (SELECT source_id FROM edges GROUP BY 1 HAVING count(*) > 1)")
register("generations", lambda v: v.pieces.select("spot_id", "track_id", "generation"), "lineage", "SELECT spot_id, track_id, generation FROM lineage")
register("tracklets", lambda v: v.pieces, "pieces", "SELECT spot_id, track_id, generation, head, tracklet_no FROM pieces")
register("tracklet_graph", lambda v: L.tracklet_graph(v.pieces, v.edges), "pieces edges",
         "SELECT DISTINCT e.track_id, b.tracklet_no, a.tracklet_no AS parent_no FROM edges e JOIN pieces a ON a.spot_id = source_id JOIN pieces b ON b.spot_id = target_id WHERE a.tracklet_no <> b.tracklet_no")
SPANS = "SELECT p.track_id, tracklet_no, min(generation) AS generation, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS spots FROM pieces p JOIN spots USING (spot_id) GROUP BY 1, 2"
register("tracklet_spans", lambda v: L.tracklet_spans(v.pieces, v.spots), "pieces", SPANS)
register("tracklet_life", lambda v: L.tracklet_life(L.tracklet_spans(v.pieces, v.spots)), "pieces", f"SELECT *, end_frame - start_frame AS life FROM ({SPANS}) WHERE generation > 0 OR end_frame > start_frame")
register("propagate_fate", lambda v: L.propagate_fate(v.spots, v.annotations.select(F.col("ann_id").alias("spot_id"), (F.col("ann_id") % 4).alias("fate"))), "spots annotations",
         "WITH f AS (SELECT track_id, max(ann_id % 4) AS fate FROM annotations JOIN spots ON spot_id = ann_id GROUP BY 1) SELECT spot_id, coalesce(fate, -1) AS fate FROM spots LEFT JOIN f USING (track_id)")
register("ancestors_of", lambda v: L.ancestors_of(v.edges, L.leaves(v.edges)), "edges",
         """SELECT * FROM (WITH RECURSIVE a AS (SELECT target_id AS spot_id, source_id AS ancestor FROM edges WHERE target_id NOT IN (SELECT source_id FROM edges)
         UNION ALL SELECT a.spot_id, e.source_id FROM a JOIN edges e ON e.target_id = a.ancestor) SELECT DISTINCT * FROM a)""")  # fmt: skip
register("keep_filtered", lambda v: L.keep_filtered(v.spots, v.annotations.join(v.spots, F.col("ann_id") == F.col("spot_id")).select("track_id")).select("spot_id", "track_id"), "spots annotations",
         "SELECT spot_id, track_id FROM spots WHERE track_id IN (SELECT track_id FROM spots JOIN annotations ON ann_id = spot_id)")

register("kinematics", lambda v: v.motion, "motion", "SELECT * FROM motion", "speed acceleration motion_angle_z motion_angle_y motion_angle_x radial_angle_z radial_angle_y radial_angle_x")
ROOT = """WITH r AS (SELECT DISTINCT ON (track_id) track_id, z, y, x FROM spots WHERE spot_id IN (SELECT source_id FROM edges) AND spot_id NOT IN (SELECT target_id FROM edges) ORDER BY track_id, frame, spot_id),
m AS (SELECT spot_id, s.track_id, frame, coalesce((s.z - r.z) * (s.z - r.z) + (s.y - r.y) * (s.y - r.y) + (s.x - r.x) * (s.x - r.x), 0) AS msd FROM spots s LEFT JOIN r USING (track_id))"""
register("root_displacement", lambda v: K.root_displacement(v.spots, v.edges), "spots edges", f"{ROOT} SELECT spot_id, msd, sqrt(msd) AS recoil FROM m", "msd recoil")
register("before_after", lambda v: K.before_after(v.spots, v.edges), "spots edges",
         "SELECT spot_id, b.source_id AS before_id, a.target_id AS after_id FROM spots LEFT JOIN edges b ON b.target_id = spot_id LEFT JOIN (SELECT source_id, min(target_id) AS target_id FROM edges GROUP BY 1) a ON a.source_id = spot_id")
STEPS = """SELECT e.track_id, source_id, target_id, a.frame AS from_frame, b.frame AS to_frame, b.z - a.z AS dz, b.y - a.y AS dy, b.x - a.x AS dx,
 sqrt((b.z - a.z) * (b.z - a.z) + (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) AS displacement FROM edges e JOIN spots a ON a.spot_id = source_id JOIN spots b ON b.spot_id = target_id"""
register("edge_steps", lambda v: K.edge_steps(v.spots, v.edges), "spots edges", STEPS, "dz dy dx displacement")
SUMMARY = f"""
WITH st AS ({STEPS}), sp AS (SELECT *, displacement / greatest(1, to_frame - from_frame) AS speed FROM st),
a AS (SELECT track_id, sum(displacement) AS total_distance, avg(speed) AS mean_speed, max(speed) AS max_speed, min(speed) AS min_speed, quantile_cont(speed, 0.5) AS median_speed, stddev_samp(speed) AS std_speed FROM sp GROUP BY 1),
b AS (SELECT track_id, count(*) AS number_spots, min(frame) AS start, max(frame) AS stop, avg(z) AS mean_z, avg(y) AS mean_y, avg(x) AS mean_x FROM spots GROUP BY 1),
f AS (SELECT DISTINCT ON (track_id) track_id, z, y, x FROM spots ORDER BY track_id, frame, spot_id),
l AS (SELECT DISTINCT ON (track_id) track_id, z, y, x FROM spots ORDER BY track_id, frame DESC, spot_id DESC),
m AS (SELECT track_id, max(sqrt((s.z - f.z) * (s.z - f.z) + (s.y - f.y) * (s.y - f.y) + (s.x - f.x) * (s.x - f.x))) AS max_distance FROM spots s JOIN f USING (track_id) GROUP BY 1),
d AS (SELECT track_id, sqrt((l.z - f.z) * (l.z - f.z) + (l.y - f.y) * (l.y - f.y) + (l.x - f.x) * (l.x - f.x)) AS displacement FROM f JOIN l USING (track_id)),
mg AS (SELECT track_id, count(*) AS number_merges FROM (SELECT track_id, target_id FROM edges GROUP BY ALL HAVING count(*) > 1) GROUP BY 1), gp AS (SELECT track_id, count(*) AS number_gaps FROM st WHERE to_frame - from_frame > 1 GROUP BY 1),
s2 AS (SELECT track_id, count(*) AS number_splits FROM (SELECT track_id, source_id FROM edges GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
SELECT b.*, a.* EXCLUDE (track_id), max_distance, coalesce(number_splits, 0) AS number_splits, coalesce(number_merges, 0) AS number_merges, coalesce(number_gaps, 0) AS number_gaps,
 CAST(stop - start AS DOUBLE) AS duration, displacement, displacement / nullif(CAST(stop - start AS DOUBLE), 0) AS straight_speed, displacement / nullif(CAST(stop - start AS DOUBLE), 0) / nullif(mean_speed, 0) AS linearity
FROM b LEFT JOIN a USING (track_id) JOIN m USING (track_id) JOIN d USING (track_id) LEFT JOIN s2 USING (track_id) LEFT JOIN mg USING (track_id) LEFT JOIN gp USING (track_id)"""
MEASURES = "mean_z mean_y mean_x total_distance mean_speed max_speed min_speed median_speed std_speed max_distance duration displacement straight_speed linearity"
register("track_quality", lambda v: K.track_summary(v.spots.withColumn("quality", F.col("intensity")), v.edges).select("track_id", "mean_quality"), "spots", "SELECT track_id, avg(intensity) AS mean_quality FROM spots GROUP BY 1", "mean_quality")
register("track_summary", lambda v: K.track_summary(v.spots, v.edges), "spots edges", SUMMARY, MEASURES)
TANGLED = """spots AS (SELECT spot_id, track_id, 2 * frame - frame % 7 AS frame, z, y, x FROM straight), edges AS (FROM links UNION ALL SELECT a.track_id, a.source_id, b.target_id FROM links a JOIN links b ON b.source_id = a.target_id WHERE b.target_id % 20 = 0)"""
register("track_summary_tangled", lambda v: K.track_summary(v.spots.withColumn("frame", 2 * F.col("frame") - F.col("frame") % 7), v.edges.unionByName(v.edges.select("track_id", "source_id", F.col("target_id").alias("_m")).join(v.edges.select(F.col("source_id").alias("_m"), "target_id"), "_m").where("target_id % 20 = 0").drop("_m"))), "spots edges",
         f"SELECT * FROM (WITH straight AS (SELECT spot_id, track_id, frame, z, y, x FROM spots), links AS (SELECT track_id, source_id, target_id FROM edges) SELECT * FROM (WITH {TANGLED}{SUMMARY.strip().replace('WITH st AS', ', st AS', 1)}))", MEASURES)
register("broadcast_track_stats", lambda v: K.broadcast_track_stats(v.spots, K.track_summary(v.spots, v.edges), ["displacement", "max_distance"]), "spots edges",
         f"SELECT spot_id, displacement, max_distance FROM spots JOIN ({SUMMARY}) USING (track_id)", "displacement max_distance")
register("mean_square_lag", lambda v: K.mean_square_lag(v.spots.select(F.col("track_id").alias("key"), F.col("seq").alias("i"), "z", "y", "x"), 5), "spots",
         "SELECT CAST(lag AS INTEGER) AS lag, count(*) AS pairs, avg((b.z - a.z) ** 2 + (b.y - a.y) ** 2 + (b.x - a.x) ** 2) AS mean_square FROM range(1, 6) r(lag) JOIN spots a ON true JOIN spots b ON b.track_id = a.track_id AND b.seq = a.seq + lag GROUP BY 1", "mean_square")


def tracklet_values(v, column):
    """(key, i, value): a column along each tracklet, whose key is its head."""
    place = F.row_number().over(Window.partitionBy("head").orderBy("frame", "spot_id")) - 1
    return v.pieces.select("spot_id", "head").join(v.spots.select("spot_id", "frame", column), "spot_id").select(F.col("head").alias("key"), place.alias("i"), F.col(column).alias("value"))


register("intensity_spectrum", lambda v: K.intensity_spectrum(tracklet_values(v, "intensity")), "pieces",
         """WITH s AS (SELECT head, intensity, (row_number() OVER (PARTITION BY head ORDER BY frame, spot_id) - 1) AS i FROM pieces JOIN (SELECT spot_id, frame, intensity FROM spots) USING (spot_id)),
         n AS (SELECT head, count(*) AS n FROM s GROUP BY 1), w AS (SELECT head, n, CAST(unnest(range(0, greatest(1, n // 2))) AS INTEGER) AS k FROM n)
         SELECT head AS key, k, k / CAST(n AS DOUBLE) AS frequency, sqrt(sum(intensity * cos(-2 * pi() * k * i / n)) ** 2 + sum(intensity * sin(-2 * pi() * k * i / n)) ** 2) AS magnitude FROM s JOIN w USING (head) GROUP BY 1, 2, n""", "frequency magnitude")  # fmt: skip

register("axis_angle", lambda v: v.spots.select("spot_id", *[S.axis_angle(F.col("z") - 10, F.col("y") - 50, F.col("x"), c).alias(f"angle_{c}") for c in "zyx"]), "spots",
         "SELECT spot_id, " + ", ".join(f"degrees(acos(greatest(-1, least(1, ({e}) / nullif(sqrt((z - 10) * (z - 10) + (y - 50) * (y - 50) + x * x), 0))))) AS angle_{c}" for c, e in (("z", "z - 10"), ("y", "y - 50"), ("x", "x"))) + " FROM spots", "angle_z angle_y angle_x")
register("scale_values", lambda v: v.spots.select("spot_id", S.saturating(F.col("x") / 100).alias("saturated"), S.rescale(F.col("y"), 2.5).alias("rescaled"), S.to_pixels(F.col("x"), 0.5).alias("pixels"), S.to_pixels(F.col("x"), 0.5, "round").alias("pixels_round"), S.to_pixels(F.col("x"), 0.5, "truncate").alias("pixels_int"),
         S.with_sentinel(S.null_sentinel(F.col("radius"))).alias("radius_back"), S.usable_radius(F.col("radius")).alias("usable_radius"), S.pick_channel(1, F.col("x"), S.null_sentinel(F.col("radius"))).alias("channel")), "spots",
         """SELECT spot_id, 1 - exp(-x / 100) AS saturated, y * 2.5 AS rescaled, x / 0.5 AS pixels, round_even(x, 0) / 0.5 AS pixels_round, CAST(trunc(x / 0.5) AS INTEGER) AS pixels_int,
         coalesce(nullif(radius, -1), -1) AS radius_back, CASE WHEN radius > 0 THEN radius END AS usable_radius, coalesce(nullif(radius, -1), -1) AS channel FROM spots""", "saturated rescaled pixels pixels_round radius_back usable_radius channel")  # fmt: skip
register("zscore", lambda v: S.zscore(v.spots.select("spot_id", "frame", "x"), "x", ["frame"]).select("spot_id", "x_z"), "spots",
         "SELECT spot_id, (x - avg(x) OVER (PARTITION BY frame)) / nullif(stddev_pop(x) OVER (PARTITION BY frame), 0) AS x_z FROM spots", "x_z")
register("minmax_scale", lambda v: v.spots.groupBy("frame").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).join(v.spots.select("spot_id", "frame", "x"), "frame").select("spot_id", S.minmax_scale(F.col("x"), F.col("lo"), F.col("hi")).alias("scaled")), "spots",
         "SELECT spot_id, (x - min(x) OVER (PARTITION BY frame)) / (max(x) OVER (PARTITION BY frame) - min(x) OVER (PARTITION BY frame) + 1e-20) AS scaled FROM spots", "scaled")
NAME = "concat('Dividing_', track_id % 5, '_Cell_Type_', coalesce(cell_type, '9'), '_', seq)"
register("names", lambda v: v.spots.select("spot_id", F.expr(NAME).alias("name")).select("spot_id", S.division_count_in(F.col("name")).alias("divisions"), S.cell_type_in(F.col("name")).alias("cell_type"), F.array_join(S.numbers_in(F.col("name")).cast("array<string>"), ",").alias("numbers")), "spots",
         f"SELECT spot_id, track_id % 5 AS divisions, coalesce(cell_type, '-1') AS cell_type, array_to_string(regexp_extract_all({NAME}, '[0-9]+'), ',') AS numbers FROM spots")
register("arrange_scale", lambda v: v.spots.select("spot_id", F.posexplode(S.arrange_scale(F.when(F.col("spot_id") % 2 == 0, "TZYX").otherwise("XY"), {"T": 1, "Z": 2, "Y": 0.5, "X": 0.25})).alias("i", "scale")).withColumn("i", F.col("i").cast("long")), "spots",
         "SELECT spot_id, CAST(i AS BIGINT) AS i, CAST(CASE WHEN spot_id % 2 = 0 THEN [1, 2, 0.5, 0.25] ELSE [0.25, 0.5] END[i + 1] AS DOUBLE) AS scale FROM spots, range(0, 4) r(i) WHERE spot_id % 2 = 0 OR i < 2")
register("time_step_lookup", lambda v: S.time_steps(v.spots.select("spot_id", "frame"), v.spark.createDataFrame([(10, 1.5), (30, 2.0), (50, 2.5)], "until_frame long, interval double")).select("spot_id", "interval"), "spots",
         "SELECT spot_id, CAST(CASE WHEN frame <= 10 THEN 1.5 WHEN frame <= 30 THEN 2.0 ELSE 2.5 END AS DOUBLE) AS interval FROM spots")
register("tracklet_key", lambda v: v.pieces.select("spot_id", S.tracklet_key(F.col("track_id"), F.col("generation"), F.col("tracklet_no")).alias("key")), "pieces", "SELECT spot_id, CAST(concat(track_id, generation, tracklet_no) AS BIGINT) AS key FROM pieces")
register("add_noise", lambda v: S.add_noise(v.spots.select("spot_id", "x"), ["x"], 0.5))
register("drop_invalid_rows", lambda v: S.drop_invalid_rows(v.spots.withColumn("x", F.when(F.col("spot_id") % 7 == 0, float("nan")).when(F.col("spot_id") % 11 != 0, F.col("x"))), ["x", "y"]).select("spot_id"), "spots", "SELECT spot_id FROM spots WHERE spot_id % 7 <> 0 AND spot_id % 11 <> 0")
register("attach_tracklet_dim", lambda v: L.attach_tracklet_dim(v.spots, v.pieces), "pieces",
         f"SELECT spot_id, p.track_id, s.generation, tracklet_no, end_frame - start_frame AS life FROM pieces p JOIN ({SPANS}) s USING (track_id, tracklet_no)")
WALK = """
WITH RECURSIVE w AS (
 SELECT s.spot_id, s.spot_id AS root, [s.spot_id] AS path FROM spots s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = s.spot_id)
 UNION ALL SELECT e.target_id, w.root, list_append(w.path, e.target_id) FROM w JOIN edges e ON e.source_id = w.spot_id),
 d AS (SELECT spot_id, count(*) - 1 AS descendants FROM (SELECT unnest(path) AS spot_id FROM w) GROUP BY 1),
 p AS (SELECT spot_id, root, 2 * (row_number() OVER (PARTITION BY root ORDER BY path) - 1) - (len(path) - 1) AS enter FROM w)
SELECT p.spot_id, root, enter, enter + 2 * descendants + 1 AS leave, descendants FROM p JOIN d USING (spot_id)"""
register("lineage_intervals", lambda v: L.intervals(v.spots, v.edges), "spots edges", f"SELECT spot_id, root, enter, leave FROM ({WALK})")
register("descendant_counts", lambda v: L.descendant_counts(L.intervals(v.spots, v.edges)), "spots edges", f"SELECT spot_id, descendants FROM ({WALK})")
register("related_spots", lambda v: L.related(v.spots.select(F.col("spot_id").alias("a"), (F.col("spot_id") + 7 - F.col("seq")).alias("b")).unionByName(v.edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))), L.intervals(v.spots, v.edges)), "spots edges",
         f"""WITH w AS ({WALK}), q AS (SELECT spot_id AS a, spot_id + 7 - seq AS b FROM spots UNION ALL SELECT source_id, target_id FROM edges)
         SELECT q.a, q.b, coalesce(x.root = y.root AND x.enter < y.enter AND y.leave < x.leave, false) AS descends FROM q LEFT JOIN w x ON x.spot_id = q.a LEFT JOIN w y ON y.spot_id = q.b""")  # fmt: skip
