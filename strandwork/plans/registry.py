"""Registered queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import NEEDS, VIEWS, Views, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Views of SQL only: lineage by recursion and motion by self-joins, other ways than the operators'.
LINEAGE = """
SELECT * FROM (
 WITH RECURSIVE sp AS (SELECT source_id FROM edges GROUP BY 1 HAVING count(*) > 1),
 g AS (
  SELECT s.spot_id, s.track_id, CAST(0 AS BIGINT) AS generation, s.spot_id AS head FROM spots s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = s.spot_id)
  UNION ALL
  SELECT e.target_id, g.track_id, g.generation + CASE WHEN sp.source_id IS NULL THEN 0 ELSE 1 END, CASE WHEN sp.source_id IS NULL THEN g.head ELSE e.target_id END
  FROM g JOIN edges e ON e.source_id = g.spot_id LEFT JOIN sp ON sp.source_id = g.spot_id)
 SELECT * FROM g)"""
PIECES = """
SELECT l.*, n.tracklet_no FROM lineage l JOIN (
 SELECT h.head, CAST(row_number() OVER (PARTITION BY h.track_id ORDER BY h.generation, s.frame, h.head) - 1 AS BIGINT) AS tracklet_no
 FROM lineage h JOIN spots s ON s.spot_id = h.spot_id WHERE h.spot_id = h.head) n ON n.head = l.head"""
ANGLE = "coalesce(degrees(acos(greatest(-1, least(1, ({c}) / nullif(sqrt(({z}) * ({z}) + ({y}) * ({y}) + ({x}) * ({x})), 0))))), {d})"
STEP = {c: f"s.{c} - p.{c}" for c in "zyx"}
MOTION = f"""
SELECT s.spot_id, s.track_id, s.frame,
 coalesce(sqrt((s.z - p.z) * (s.z - p.z) + (s.y - p.y) * (s.y - p.y) + (s.x - p.x) * (s.x - p.x)) / greatest(1, s.frame - p.frame), 0) AS speed,
 coalesce(sqrt((s.z - 2 * p.z + q.z) * (s.z - 2 * p.z + q.z) + (s.y - 2 * p.y + q.y) * (s.y - 2 * p.y + q.y) + (s.x - 2 * p.x + q.x) * (s.x - 2 * p.x + q.x)) / greatest(1, s.frame - q.frame), 0) AS acceleration,
 {", ".join(ANGLE.format(c=STEP[c], d=0, **STEP) + f" AS motion_angle_{c}" for c in "zyx")},
 {", ".join(ANGLE.format(c=f"s.{c}", z="s.z", y="s.y", x="s.x", d="NULL") + f" AS radial_angle_{c}" for c in "zyx")}
FROM spots s LEFT JOIN edges e ON e.target_id = s.spot_id LEFT JOIN spots p ON p.spot_id = e.source_id
LEFT JOIN edges f ON f.target_id = p.spot_id LEFT JOIN spots q ON q.spot_id = f.source_id"""
#: Eigenvalues of a region's covariance in closed form, its longest axis, its exposed faces; what spots take from regions, masks and labels around them.
MOMENTS = """
SELECT * FROM (
 WITH c AS (SELECT t, label, covar_samp(z, z) AS zz, covar_samp(y, y) AS yy, covar_samp(x, x) AS xx, covar_samp(z, y) AS zy, covar_samp(z, x) AS zx, covar_samp(y, x) AS yx FROM voxels WHERE label > 0 GROUP BY 1, 2 HAVING count(*) > 3),
 q AS (SELECT *, (zz + yy + xx) / 3 AS q FROM c),
 p AS (SELECT *, sqrt(((zz - q) * (zz - q) + (yy - q) * (yy - q) + (xx - q) * (xx - q) + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS p FROM q),
 r AS (SELECT *, acos(greatest(-1, least(1, ((zz - q) * ((yy - q) * (xx - q) - yx * yx) - zy * (zy * (xx - q) - yx * zx) + zx * (zy * yx - (yy - q) * zx)) / nullif(p * p * p, 0) / 2))) / 3 AS phi FROM p),
 e AS (SELECT *, coalesce(q + 2 * p * cos(phi), q) AS e1, coalesce(q + 2 * p * cos(phi + 2 * pi() / 3), q) AS e3 FROM r),
 v AS (SELECT *, 3 * q - e1 - e3 AS e2, [[zy * yx - zx * (yy - e1), zx * zy - (zz - e1) * yx, (zz - e1) * (yy - e1) - zy * zy], [zy * (xx - e1) - zx * yx, zx * zx - (zz - e1) * (xx - e1), (zz - e1) * yx - zy * zx], [(yy - e1) * (xx - e1) - yx * yx, yx * zx - zy * (xx - e1), zy * yx - (yy - e1) * zx]] AS axes FROM e),
 a AS (SELECT *, list_sort(list_transform(axes, lambda w: [sqrt(w[1] * w[1] + w[2] * w[2] + w[3] * w[3]), w[1], w[2], w[3]]), 'DESC')[1] AS w FROM v)
 SELECT t, label, sqrt(greatest(e1, 0)) AS eccentricity_first, sqrt(greatest(e2, 0)) AS eccentricity_second, sqrt(greatest(e3, 0)) AS eccentricity_third, greatest(e1, 0) AS eigen_first, greatest(e2, 0) AS eigen_second, greatest(e3, 0) AS eigen_third,
  CASE WHEN e1 - e2 > 1e-6 * e1 THEN degrees(acos(least(1, abs(w[2]) / nullif(w[1], 0)))) END AS cell_axis_z, CASE WHEN e1 - e2 > 1e-6 * e1 THEN degrees(acos(least(1, abs(w[3]) / nullif(w[1], 0)))) END AS cell_axis_y, CASE WHEN e1 - e2 > 1e-6 * e1 THEN degrees(acos(least(1, abs(w[4]) / nullif(w[1], 0)))) END AS cell_axis_x
 FROM a)"""
FACES = "SELECT a.t, a.label, CAST(6 * count(*) - sum((SELECT count(*) FROM voxels b WHERE b.t = a.t AND b.label = a.label AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1)) AS DOUBLE) AS area FROM voxels a WHERE a.label > 0 GROUP BY 1, 2"
SHAPES = f"""
SELECT * FROM (
 WITH j AS (SELECT r.t, r.label, r.z, r.y, r.x, r.size, m.* EXCLUDE (t, label), f.area FROM (SELECT t, label, avg(z) AS z, avg(y) AS y, avg(x) AS x, count(*) AS size FROM voxels WHERE label > 0 GROUP BY 1, 2) r LEFT JOIN ({MOMENTS}) m USING (t, label) LEFT JOIN ({FACES}) f USING (t, label))
 SELECT * FROM j WHERE t IN (SELECT t FROM j GROUP BY 1 HAVING count(eccentricity_first) > 1))"""
GAP = "sqrt((s.z - b.z) * (s.z - b.z) + (s.y - b.y) * (s.y - b.y) + (s.x - b.x) * (s.x - b.x))"
AROUND = f"""
SELECT spot_id, label, e AS region_radius, eccentricity_first, eccentricity_second, eccentricity_third, area AS surface_area, cell_axis_z, cell_axis_y, cell_axis_x FROM (
 SELECT DISTINCT ON (s.spot_id) s.spot_id, b.* EXCLUDE (t, z, y, x), cbrt(eigen_first * eigen_second * eigen_third) AS e, {GAP} AS d FROM spots s JOIN shapes b ON b.t = s.frame AND {GAP} <= 12 ORDER BY s.spot_id, {GAP}, b.label) WHERE d < e"""
MASK = f"""
SELECT * FROM (
 WITH b AS (SELECT DISTINCT a.t AS frame, CAST(a.z AS DOUBLE) AS z, CAST(a.y AS DOUBLE) AS y, CAST(a.x AS DOUBLE) AS x FROM voxels a JOIN voxels b ON a.t = b.t AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.label > 0 AND b.label = 0),
 m AS (SELECT frame, avg(z) AS mz, avg(y) AS my, avg(x) AS mx FROM b GROUP BY 1)
 SELECT s.spot_id, coalesce(min({GAP}), 0) AS distance_cell_mask, coalesce(any_value(mz), 1) AS mask_centroid_z, coalesce(any_value(my), 1) AS mask_centroid_y, coalesce(any_value(mx), 1) AS mask_centroid_x FROM spots s LEFT JOIN b ON s.frame = b.frame LEFT JOIN m ON m.frame = s.frame GROUP BY 1)"""
DENSITY = "SELECT spot_id, count(DISTINCT label) AS local_density FROM spots s LEFT JOIN voxels b ON b.t = s.frame AND abs(b.z - s.z) <= 4 AND abs(b.y - s.y) <= 4 AND abs(b.x - s.x) <= 4 GROUP BY 1"
KNOWN = """
SELECT s.spot_id, s.track_id, s.frame, s.z, s.y, s.x, CASE WHEN s.radius > 0 THEN coalesce(g.region_radius, s.radius) END AS radius, s.intensity AS total_intensity, p.head, p.generation, p.tracklet_no, m.* EXCLUDE (spot_id, track_id, frame),
 coalesce((s.z - r.z) * (s.z - r.z) + (s.y - r.y) * (s.y - r.y) + (s.x - r.x) * (s.x - r.x), 0) AS msd, sqrt(coalesce((s.z - r.z) * (s.z - r.z) + (s.y - r.y) * (s.y - r.y) + (s.x - r.x) * (s.x - r.x), 0)) AS recoil,
 CASE WHEN s.radius > 0 THEN g.eccentricity_first END AS eccentricity_first, CASE WHEN s.radius > 0 THEN g.eccentricity_second END AS eccentricity_second, CASE WHEN s.radius > 0 THEN g.eccentricity_third END AS eccentricity_third, CASE WHEN s.radius > 0 THEN g.surface_area END AS surface_area,
 g.cell_axis_z, g.cell_axis_y, g.cell_axis_x, b.distance_cell_mask, l.local_density
FROM spots s JOIN pieces p ON p.spot_id = s.spot_id JOIN motion m ON m.spot_id = s.spot_id LEFT JOIN (SELECT DISTINCT ON (track_id) track_id, z, y, x FROM spots WHERE spot_id IN (SELECT source_id FROM edges) AND spot_id NOT IN (SELECT target_id FROM edges) ORDER BY track_id, frame, spot_id) r ON r.track_id = s.track_id
LEFT JOIN around g ON g.spot_id = s.spot_id LEFT JOIN mask b ON b.spot_id = s.spot_id LEFT JOIN density l ON l.spot_id = s.spot_id"""
TEXTS = VIEWS | {"lineage": LINEAGE, "pieces": PIECES, "motion": MOTION, "shapes": SHAPES, "around": AROUND, "mask": MASK, "density": DENSITY, "known": KNOWN}
DEPENDS = {k: [x for x in v if x in VIEWS] for k, v in NEEDS.items()} | {
    "lineage": ["spots", "edges"], "pieces": ["lineage", "spots"], "motion": ["spots", "edges"], "shapes": ["voxels"], "around": ["spots", "shapes"], "mask": ["spots", "voxels"], "density": ["spots", "voxels"],
    "known": ["spots", "edges", "pieces", "motion", "around", "mask", "density"],
}


def with_views(names: str, sql: str) -> str:
    """sql after the CTEs that it and they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in DEPENDS[name]:
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return ("WITH " + ",\n".join(f"{n} AS ({TEXTS[n]})" for n in order) + "\n" if order else "") + sql


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, without a negative zero."""
    return df.select(*[(F.round(F.col(c), 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, make: Callable[[Views], DataFrame], needs: str = "", sql: str | None = None, doubles: str = "") -> None:
    """One query, and its SQL over the named views; doubles: the columns that SQL rounds as rounded() does."""
    QUERIES[name] = lambda spark, sf_dir: rounded(make(views(spark, sf_dir)))
    if sql:
        body = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in doubles.split())}) FROM ({sql})" if doubles else sql
        SQL[name] = with_views(needs, f"SELECT * FROM ({body})" if body.lstrip().startswith("WITH") else body)


from . import catalog_analysis, catalog_files, catalog_lineage, catalog_more, catalog_series, catalog_space, catalog_tables  # noqa: E402,F401  they register
