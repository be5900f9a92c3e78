"""Writers: enriched spots, second channels, class tables, feature slices, barcodes and cluster points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enriched_spots(spots: DataFrame, *derived: DataFrame) -> DataFrame:
    """spots with every derived table's columns, joined on spot_id; columns that spots has already stay its own."""
    for d in derived:
        spots = spots.join(d.select("spot_id", *[c for c in d.columns if c not in spots.columns]), "spot_id", "left")
    return spots


def write_enriched_spots(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or XML with one Spot element per row for interchange."""
    if kind == "xml":
        rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns]).write.format("xml").option("rootTag", "AllSpots").option("rowTag", "Spot").save(path)
    else:
        rows.write.format(kind).save(path)


def channel_spots(spots: DataFrame, matched: DataFrame, first_only: bool = False) -> DataFrame:
    """spots with the second channel's place and intensity where one was matched, else their own; first_only keeps them for each track's first spot alone."""
    new = matched.select("spot_id", *[F.col(f"c2_{c}").alias(f"_{c}") for c in ("z", "y", "x")], F.col("c2_intensity").cast("double").alias("_intensity"))
    if first_only:
        new = new.join(spots.groupBy("track_id").agg(F.min_by("spot_id", F.struct("frame", "spot_id")).alias("spot_id")).select("spot_id"), "spot_id", "left_semi")
    df = spots.join(new, "spot_id", "left")
    return df.withColumns({c: F.coalesce(f"_{c}", c) for c in ("z", "y", "x", "intensity")}).drop("_z", "_y", "_x", "_intensity")


def write_channel_spots(spots: DataFrame, matched: DataFrame, path: str, first_only: bool = False) -> None:
    channel_spots(spots, matched, first_only).write.parquet(path)


def write_class_tables(rows: DataFrame, path: str, label: str = "label") -> None:
    """One folder of CSV per class."""
    rows.write.partitionBy(label).option("header", True).csv(path)


def feature_slices(rows: DataFrame, cohort: str, features: Sequence[str]) -> DataFrame:
    """(spot_id, cohort, feature, value)."""
    return rows.unpivot(["spot_id", cohort], list(features), "feature", "value").withColumnRenamed(cohort, "cohort")


def write_feature_slices(rows: DataFrame, cohort: str, features: Sequence[str], path: str) -> None:
    feature_slices(rows, cohort, features).write.partitionBy("feature", "cohort").parquet(path)


def write_loops(bars: DataFrame, path: str) -> None:
    """Birth, death and persistence per frame."""
    bars.select("t", "birth", "death", (F.col("death") - F.col("birth")).alias("persistence")).write.partitionBy("t").option("header", True).csv(path)


def write_cluster_points(rows: DataFrame, path: str, label: str = "cluster") -> None:
    rows.select(F.col("frame").alias("t"), "y", "x", F.col(label).alias("cluster")).write.option("header", True).csv(path)
