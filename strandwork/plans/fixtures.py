"""Views that stand in for tracker output, made from the given tables; one SQL text each for Spark and DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "spots": """
WITH r AS (SELECT event_id, user_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS n FROM events),
s AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN CAST((n - n % 4) / 4 AS BIGINT) ELSE 0 END AS seg, CASE WHEN user_id % 3 = 0 THEN n % 4 ELSE n END AS pos FROM r),
g AS (SELECT *, CASE WHEN seg + 1 >= 32 THEN 5 WHEN seg + 1 >= 16 THEN 4 WHEN seg + 1 >= 8 THEN 3 WHEN seg + 1 >= 4 THEN 2 WHEN seg + 1 >= 2 THEN 1 ELSE 0 END AS gen FROM s)
SELECT event_id AS spot_id, user_id AS track_id, CAST(4 * gen + pos AS BIGINT) AS frame, CAST(event_id * 7919 % 200 AS DOUBLE) / CAST(10 AS DOUBLE) AS z,
 CAST(event_id * 104729 % 1000 AS DOUBLE) / CAST(10 AS DOUBLE) AS y, CAST(value AS DOUBLE) AS x, CAST(event_id % 9 - 1 AS DOUBLE) AS radius,
 CAST(event_id * 31 % 977 AS DOUBLE) / CAST(8 AS DOUBLE) AS intensity,
 CASE user_id % 4 WHEN 0 THEN 'Basal' WHEN 1 THEN 'Radial' WHEN 2 THEN 'Goblet' ELSE NULL END AS cell_type, n AS seq, seg, gen
FROM g""",
    "edges": """
SELECT c.track_id, p.spot_id AS source_id, c.spot_id AS target_id FROM spots c JOIN spots p ON p.track_id = c.track_id
 AND p.seq = CASE WHEN c.track_id % 3 <> 0 THEN c.seq - 1 WHEN c.seq % 4 <> 0 THEN c.seq - 1 ELSE CAST(((c.seg - 1) - (c.seg - 1) % 2) / 2 AS BIGINT) * 4 + 3 END
WHERE c.seq > 0""",
    "pred_spots": """
SELECT spot_id + 10000000 AS spot_id, track_id + 1000000 AS track_id, frame, z, y, x + CAST(spot_id % 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS x
FROM spots WHERE track_id % 10 <> 0 AND spot_id % 11 <> 0""",
    "pred_edges": """
SELECT e.track_id + 1000000 AS track_id, a.spot_id AS source_id, b.spot_id AS target_id FROM edges e
JOIN pred_spots a ON a.spot_id = e.source_id + 10000000 JOIN pred_spots b ON b.spot_id = e.target_id + 10000000""",
    "detections": """
SELECT event_id AS det_id, s.frame AS t, round(s.z) AS z, round(s.y) AS y, round(s.x) AS x, CAST(e.event_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS score
FROM events e JOIN spots s ON s.spot_id = e.event_id WHERE e.event_type = 'purchase'""",
    "annotations": """
SELECT spot_id AS ann_id, frame AS t, z + CAST(1 AS DOUBLE) AS z, y - CAST(1 AS DOUBLE) AS y, x, cell_type FROM spots WHERE seq = 2 AND cell_type IS NOT NULL""",
    "voxels": """
WITH c AS (SELECT CAST(l_linenumber AS BIGINT) - 1 AS t, l_orderkey % 4 AS z, l_partkey % 32 AS y, l_suppkey % 32 AS x, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT t, z, y, x, value, CASE WHEN y % 8 = 7 OR x % 8 = 7 THEN 0 ELSE 1 + CAST((y - y % 8) / 8 AS BIGINT) * 4 + CAST((x - x % 8) / 8 AS BIGINT) END AS label FROM c""",
}
NEEDS = {"spots": ["events"], "edges": ["spots"], "pred_spots": ["spots"], "pred_edges": ["edges", "pred_spots"], "detections": ["events", "spots"], "annotations": ["spots"], "voxels": ["lineitem"]}


class Views:
    """The views of one data folder as DataFrames, and the lineage that many operators share, each made once when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        frames = {n: getattr(self, n) if n in VIEWS else self.table(n) for n in NEEDS[name]}
        for n in frames:
            text = text.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ").replace(f"FROM {n})", f"FROM {{{n}}})")
        return self.spark.sql(text, **frames)

    def _written(self, name: str) -> DataFrame:
        """A view that others read several times, as a table; one with a row for each spot is joined by shuffle, and so is what is made of its rows."""
        from ..operators import lineage

        found = lineage.saved(self._view(name), name)
        return found if name == "voxels" else lineage.by_shuffle(found)

    spots = cached_property(lambda self: self._written("spots"))
    edges = cached_property(lambda self: self._written("edges"))
    pred_spots = cached_property(lambda self: self._view("pred_spots"))
    pred_edges = cached_property(lambda self: self._view("pred_edges"))
    detections = cached_property(lambda self: self._view("detections"))
    annotations = cached_property(lambda self: self._view("annotations"))
    voxels = cached_property(lambda self: self._written("voxels"))

    @cached_property
    def pieces(self) -> DataFrame:
        from ..operators import lineage

        return lineage.by_shuffle(lineage.saved(lineage.tracklets(self.spots, self.edges), "pieces"))

    @cached_property
    def motion(self) -> DataFrame:
        from ..operators import kinematics, lineage

        return lineage.by_shuffle(lineage.saved(kinematics.kinematics(self.spots, self.edges), "motion"))

    @cached_property
    def shapes(self) -> DataFrame:
        """What each spot takes from the nearest region of its frame."""
        from ..operators import space, tables, voxels

        found = voxels.region_shapes(self.voxels).withColumnRenamed("area", "surface_area")
        return space.attach_regions(self.spots, found, 12.0, tables.REGION)

    @cached_property
    def edge_of_mask(self) -> DataFrame:
        """Foreground voxels beside a background voxel, by frame."""
        from ..operators import voxels

        return voxels.boundary_pairs(self.voxels).select(F.col("t").alias("frame"), *[F.col(c).cast("double").alias(c) for c in "zyx"]).distinct()

    @cached_property
    def known(self) -> DataFrame:
        """Every spot with all that is known of it; its sources are written first, since one plan of all would be planned again in the driver after each of its stages."""
        from ..operators import lineage, space, tables

        apart = lambda df, name: lineage.by_shuffle(lineage.saved(df, name))
        mask = apart(space.distance_to_boundary(self.spots, self.edge_of_mask).select("spot_id", "distance_cell_mask"), "mask")
        density = apart(space.label_density(self.spots, self.voxels, 2.0), "density")
        return apart(tables.properties(self.spots, self.edges, self.pieces, self.motion, apart(self.shapes, "shapes"), mask, density), "known")


def forget() -> None:
    """Drop the views made so far, so that the next query makes its own."""
    _MADE.clear()


_MADE: dict = {}


def views(spark: SparkSession, sf_dir: str) -> Views:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Views(spark, sf_dir)
    return _MADE[key]
