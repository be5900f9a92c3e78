"""Queries of clustering, connectivity, readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import connectivity as N
from ..operators import encode as E
from ..operators import space as P
from ..sources import sinks as O
from ..sources import tracker as R
from .registry import register

VEC = "(SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings)"
DIST = "sqrt(list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: (a.vector[i] - b.vector[i]) * (a.vector[i] - b.vector[i]))))"
DOT = "list_dot_product({}.vector, {}.vector)"
COS = f"1 - {DOT.format('a', 'b')} / nullif(sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')}), 0)"


def vectors(v):
    return v.table("embeddings").where("label is not null and embedding is not null").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


register("pairwise_distance", lambda v: C.pairwise_distance(vectors(v), ["label"]), "", f"SELECT a.label, a.id AS a, b.id AS b, {DIST} AS distance FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.id < b.id", "distance")
register("pairwise_cosine", lambda v: C.pairwise_distance(vectors(v), ["label"], "cosine"), "", f"SELECT a.label, a.id AS a, b.id AS b, coalesce({COS}, 0) AS distance FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.id < b.id", "distance")


def clusters(v, limit, metric="euclidean"):
    """Clusters of all embeddings: a row without label or vector, with a part that is not finite or, by cosine, without length, has no distance that is under a limit, so it is one of its own."""
    every = v.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    linked = every.where(F.col("label").isNotNull() & (F.size("vector") > 0) & finite)
    if metric == "cosine":
        linked = linked.where(F.exists("vector", lambda x: x != 0))
    found = C.threshold_clusters(linked, ["label"], limit, metric)
    return every.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


register("threshold_clusters", lambda v: clusters(v, 0.5, "cosine"), "",
         f"""SELECT id, cluster FROM (WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.id <> b.id AND {COS} < 0.5), r AS (SELECT id, id AS c FROM {VEC} UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
         SELECT id, min(c) AS cluster FROM r GROUP BY 1)""")  # fmt: skip
CENTRES = f"SELECT label, i, avg(x) AS value FROM (SELECT label, unnest(range(0, len(vector))) AS i, unnest(vector) AS x FROM {VEC}) GROUP BY 1, 2"
register("centroids", lambda v: C.centroids(vectors(v), "label").select("label", F.posexplode("vector").alias("i", "value")).withColumn("i", F.col("i").cast("long")), "", CENTRES, "value")
AWAY = f"SELECT v.id, v.label, sum((x - value) * (x - value)) AS sq FROM (SELECT id, label, unnest(range(0, len(vector))) AS i, unnest(vector) AS x FROM {VEC}) v JOIN ({CENTRES}) c ON c.label = v.label AND c.i = v.i GROUP BY 1, 2"
register("wcss", lambda v: C.wcss(vectors(v), "label"), "", f"SELECT sum(sq) AS wcss FROM ({AWAY})", "wcss")
register("spread", lambda v: C.spread(vectors(v), "label"), "", f"SELECT label, avg(sqrt(sq)) AS spread FROM ({AWAY}) GROUP BY 1", "spread")
register("silhouette", lambda v: C.silhouette(vectors(v), label="label"), "",
         f"""WITH m AS (SELECT a.id, a.label AS la, b.label AS lb, avg({DIST}) AS d FROM {VEC} a JOIN {VEC} b ON a.id <> b.id GROUP BY 1, 2, 3), s AS (SELECT id, max(CASE WHEN la = lb THEN d END) AS x, min(CASE WHEN la <> lb THEN d END) AS y FROM m GROUP BY 1)
         SELECT avg(coalesce((y - x) / nullif(greatest(x, y), 0), 0)) AS silhouette FROM s""", "silhouette")  # fmt: skip
register("k_clusters", lambda v: C.k_clusters(vectors(v), 5).select("id", "cluster"))


def chosen(v):
    """The rows of the best number of clusters."""
    k, rows = C.choose_k(vectors(v), range(2, 6))
    return (vectors(v).withColumn("cluster", F.lit(None).cast("int")) if rows is None else rows).select("id", "cluster", F.lit(k).cast("int").alias("k"))


register("choose_k", chosen)
PLACES = "(SELECT cell_type, avg(z) AS mz, avg(y) AS my, avg(x) AS mx FROM spots WHERE cell_type IS NOT NULL GROUP BY 1)"
register("position_spread", lambda v: C.position_spread(v.spots, "cell_type"), "spots", f"SELECT cell_type, avg(sqrt((z - mz) * (z - mz) + (y - my) * (y - my) + (x - mx) * (x - mx))) AS spread FROM spots JOIN {PLACES} USING (cell_type) GROUP BY 1", "spread")
register("frame_points", lambda v: N.frame_points(v.spots, True), "spots",
         "SELECT spot_id, frame, " + ", ".join(f"({c} - avg({c}) OVER (PARTITION BY frame)) / CASE WHEN stddev_pop({c}) OVER (PARTITION BY frame) = 0 THEN 1 ELSE stddev_pop({c}) OVER (PARTITION BY frame) END AS {c}" for c in "zyx") + " FROM spots", "z y x")
RIPS = "SELECT a.frame, a.spot_id AS a, b.spot_id AS b, sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS distance FROM spots a JOIN spots b ON a.frame = b.frame AND a.spot_id < b.spot_id AND sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) <= 12"
rips = lambda v: N.rips_edges(N.frame_points(v.spots), 12.0)
register("rips_edges", rips, "spots", RIPS, "distance")
bars = lambda v: N.barcodes(N.frame_points(v.spots), 12.0)
register("component_barcode", bars)
register("persistence_stats", lambda v: N.persistence_stats(bars(v)))


def simplices(v):
    from ..operators import lineage

    at = lineage.by_shuffle(lineage.saved(N.places(N.frame_points(v.spots)), "places"))
    return N.simplex_counts(at, N.rips_edges(at, 12.0), [6.0, 12.0])


register("simplex_counts", simplices, "spots",
         f"""WITH e AS (SELECT r.*, s.scale FROM ({RIPS}) r, (VALUES (CAST(6 AS DOUBLE)), (CAST(12 AS DOUBLE))) s(scale) WHERE distance <= scale), p AS (SELECT frame, scale, count(*) AS vertices FROM spots, (VALUES (CAST(6 AS DOUBLE)), (CAST(12 AS DOUBLE))) s(scale) GROUP BY 1, 2),
         n AS (SELECT frame, scale, count(*) AS edges FROM e GROUP BY 1, 2), t AS (SELECT x.frame, x.scale, count(*) AS triangles FROM e x JOIN e y ON x.frame = y.frame AND x.scale = y.scale AND x.b = y.a JOIN e z ON z.frame = x.frame AND z.scale = x.scale AND z.a = x.a AND z.b = y.b GROUP BY 1, 2)
         SELECT frame, scale, vertices, coalesce(edges, 0) AS edges, coalesce(triangles, 0) AS triangles, vertices - coalesce(edges, 0) + coalesce(triangles, 0) AS euler FROM p LEFT JOIN n USING (frame, scale) LEFT JOIN t USING (frame, scale)""")  # fmt: skip
register("renumber_track_zero", lambda v: R.renumber_track_zero(v.edges), "edges", "SELECT CASE WHEN track_id = 0 THEN (SELECT max(track_id) + 1 FROM edges) ELSE track_id END AS track_id, source_id, target_id FROM edges")
register("enriched_spots", lambda v: O.enriched_spots(v.spots.select("spot_id", "x"), v.motion.select("spot_id", "speed"), v.pieces.select("spot_id", "generation")), "pieces motion",
         "SELECT spot_id, s.x, speed, generation FROM spots s JOIN motion USING (spot_id) JOIN pieces USING (spot_id)", "x speed")
register("channel_spots", lambda v: O.channel_spots(v.spots.select("spot_id", "track_id", "frame", "z", "y", "x", "intensity"), v.annotations.select(F.col("ann_id").alias("spot_id"), F.col("z").alias("c2_z"), F.col("y").alias("c2_y"), F.col("x").alias("c2_x"), F.lit(7).alias("c2_intensity"))), "spots annotations",
         "SELECT spot_id, track_id, frame, coalesce(a.z, s.z) AS z, coalesce(a.y, s.y) AS y, coalesce(a.x, s.x) AS x, CASE WHEN ann_id IS NULL THEN intensity ELSE 7 END AS intensity FROM spots s LEFT JOIN annotations a ON ann_id = spot_id", "z y x intensity")
register("feature_slices", lambda v: O.feature_slices(v.spots, "cell_type", ["x", "intensity"]), "spots", "SELECT spot_id, cell_type AS cohort, unnest(['x', 'intensity']) AS feature, unnest([x, intensity]) AS value FROM spots", "value")
register("classify_knn", lambda v: C.classify_knn(vectors(v), vectors(v).where("id % 3 = 0"), 3), "",
         f"""SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS r FROM (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS k FROM {VEC} a JOIN {VEC} b ON a.id <> b.id AND b.id % 3 = 0) WHERE k <= 3 GROUP BY 1, 2) WHERE r = 1""")
register("classify_forest", lambda v: C.classify_forest(vectors(v), vectors(v).where("id % 3 = 0"), trees=10).select("id", "prediction"))
register("three_view_clusters", lambda v: C.three_view_clusters({"first": vectors(v).withColumn("vector", F.slice("vector", 1, 32)), "last": vectors(v).withColumn("vector", F.slice("vector", 33, 32)), "both": vectors(v)}, 4))
register("labels_to_rows", lambda v: C.labels_to_rows(vectors(v).select("id", F.col("label").alias("head")), C.centroids(vectors(v), "label").select(F.col("label").alias("head"), "vector", (F.col("label") % 3).alias("cluster"))).select("id", "cluster", "spread"), "",
         f"""WITH c AS ({CENTRES}), m AS (SELECT label % 3 AS cluster, i, avg(value) AS mean FROM c GROUP BY 1, 2), d AS (SELECT label, label % 3 AS cluster, sqrt(sum((value - mean) * (value - mean))) AS d FROM c JOIN m ON m.cluster = label % 3 AND m.i = c.i GROUP BY 1)
         SELECT v.id, v.label % 3 AS cluster, s AS spread FROM {VEC} v JOIN (SELECT cluster, avg(d) AS s FROM d GROUP BY 1) s ON s.cluster = v.label % 3""", "spread")  # fmt: skip
#: Weights of the linear encoder: small tenths by place.
register("encode_latents", lambda v: E.encode(vectors(v), E.linear, [[(7 * i + 3 * k) % 11 / 10 - 0.5 for k in range(4)] for i in range(64)], 4).select("id", F.posexplode("latent").alias("k", "value")).withColumn("k", F.col("k").cast("long")), "",
         f"SELECT id, k, sum(x * (((7 * i + 3 * k) % 11) / 10 - 0.5)) AS value FROM (SELECT id, unnest(range(0, len(vector))) AS i, unnest(vector) AS x FROM {VEC}), range(0, 4) t(k) GROUP BY 1, 2", "value")
LATER = lambda sql: sql.replace("a.vector", "a.vector[9:]").replace("b.vector", "b.vector[9:]")
register("pairwise_user_metric", lambda v: C.pairwise_metric(vectors(v), ["label"], C.skipping("cosine", 8)), "", f"SELECT a.label, a.id AS a, b.id AS b, coalesce({LATER(COS)}, 0) AS distance FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.id < b.id", "distance")
NAMES = {0: "Basal", 1: "Radial", 2: "Goblet", 3: "Ionocyte"}
register("class_names", lambda v: E.map_classes(vectors(v).select("id", F.expr("label % 6").alias("label")), NAMES, default="UnClassified"), "",
         f"SELECT id, label % 6 AS label, CASE label % 6 {' '.join(f'WHEN {k} THEN {n!r}' for k, n in NAMES.items())} ELSE 'UnClassified' END AS class_name FROM {VEC}")
register("class_numbers", lambda v: E.map_classes(v.spots.select("spot_id", "cell_type"), v.spark.createDataFrame(list(E.reversed_map(NAMES).items()), "from string, to int"), "cell_type", "class_no", -1), "spots",
         f"SELECT spot_id, cell_type, CAST(CASE cell_type {' '.join(f'WHEN {n!r} THEN {k}' for k, n in NAMES.items())} ELSE -1 END AS INTEGER) AS class_no FROM spots")
for metric, distance in (("squared", f"({DIST}) ** 2"), ("cosine", f"coalesce({COS}, 0)")):
    register(f"silhouette_{metric}", lambda v, m=metric: C.silhouette(vectors(v), m, "label"), "",
             f"""WITH m AS (SELECT a.id, a.label AS la, b.label AS lb, avg({distance}) AS d FROM {VEC} a JOIN {VEC} b ON a.id <> b.id GROUP BY 1, 2, 3), s AS (SELECT id, max(CASE WHEN la = lb THEN d END) AS x, min(CASE WHEN la <> lb THEN d END) AS y FROM m GROUP BY 1)
             SELECT avg(coalesce((y - x) / nullif(greatest(x, y), 0), 0)) AS silhouette FROM s""", "silhouette")  # fmt: skip
register("threshold_clusters_euclidean", lambda v: clusters(v, 0.6), "",
         f"""SELECT id, cluster FROM (WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.id <> b.id AND {DIST} < 0.6), r AS (SELECT id, id AS c FROM {VEC} UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
         SELECT id, min(c) AS cluster FROM r GROUP BY 1)""")  # fmt: skip
for metric, distance, limit in (("euclidean", DIST, 0.9), ("cosine", f"coalesce({COS}, 0)", 0.4)):
    register(f"near_pairs_{metric}", lambda v, m=metric, d=limit: C.near_pairs(vectors(v), ["label"], d, m), "",
             f"SELECT * FROM (SELECT a.label, a.id AS a, b.id AS b, {distance} AS distance FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.id < b.id) WHERE distance < {limit}", "distance")
register("nearest_vectors", lambda v: C.nearest_vectors(vectors(v), vectors(v).where("id % 3 = 0"), 3).select("id", "other", "label", "d"), "",
         f"SELECT id, other, label, d FROM (SELECT a.id, b.id AS other, b.label, {DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS k FROM {VEC} a JOIN {VEC} b ON a.id <> b.id AND b.id % 3 = 0) WHERE k <= 3", "d")
