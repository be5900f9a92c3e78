"""Tracklet windows and vectors: series, blocks, windows, fixed lengths and covariances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str = "head") -> DataFrame:
    """rows plus i, the place (from 0) within their tracklet by (frame, spot_id)."""
    return rows.withColumn("i", (F.row_number().over(Window.partitionBy(key).orderBy("frame", "spot_id")) - 1).cast("long"))


def tracklet_series(rows: DataFrame, features: Sequence[str], key: str = "head") -> DataFrame:
    """(key, series): array of (frame, spot_id, features) in order of time, one row per tracklet."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("frame", "spot_id", *features))).alias("series"))


def dividing_tracklets(rows: DataFrame, flag: str = "dividing", key: str = "head") -> DataFrame:
    """All rows of tracklets with any flagged row."""
    return rows.join(rows.where(flag).select(key).distinct(), key, "left_semi")


def blocks(rows: DataFrame, n: int, key: str = "head") -> DataFrame:
    """rows plus block: consecutive blocks of n rows per tracklet; a short tail is dropped."""
    cut = numbered(rows, key).withColumn("block", F.floor(F.col("i") / n))
    return cut.withColumn("_n", F.count("*").over(Window.partitionBy(key, "block"))).where(F.col("_n") == n).drop("_n")


def sliding_windows(rows: DataFrame, length: int, key: str = "head", include_last: bool = True) -> DataFrame:
    """(key, start, k, row's columns): every window of length rows; include_last=False omits the last start, as sampled training windows do."""
    at = numbered(rows, key).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    spread = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("start", F.col("i") - F.col("k"))
    last = F.col("_n") - length - (0 if include_last else 1)
    return spread.where((F.col("start") >= 0) & (F.col("start") <= last)).drop("_n", "i")


def fit_length(rows: DataFrame, length: int, key: str = "head") -> DataFrame:
    """rows at places k = 0 .. length - 1: the first length rows, or the last one repeated."""
    at = numbered(rows, key).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    last = F.col("i") == F.col("_n") - 1
    k = F.when(last & (F.col("i") < length - 1), F.sequence(F.col("i"), F.lit(length - 1).cast("long"))).otherwise(F.array("i"))
    return at.where(F.col("i") < length).withColumn("k", F.explode(k)).drop("_n", "i")


def centre_row(rows: DataFrame, length: int, key: str = "head") -> DataFrame:
    return fit_length(rows, length, key).where(F.col("k") == length // 2)


def min_length(rows: DataFrame, n: int, key: str = "head") -> DataFrame:
    """Rows of tracklets with more than one row and at least n."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) & (F.col("_n") >= n))
    return rows.join(sizes.select(key), key, "left_semi")


def covariance_wide(rows: DataFrame, features: Sequence[str], key: str = "head") -> DataFrame:
    """One aggregate with a column c_i_j per pair i <= j."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    return rows.groupBy(key).agg(*[F.covar_samp(features[i], features[j]).alias(f"c_{i}_{j}") for i, j in pairs])


def covariance_long(rows: DataFrame, features: Sequence[str], key: str = "head") -> DataFrame:
    """(key, i, j, covariance) of every feature pair (both orders) per tracklet; null for tracklets of one row."""
    wide = covariance_wide(rows, features, key)
    n = range(len(features))
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c_{min(i, j)}_{max(i, j)}").alias("covariance")) for i in n for j in n])
    return wide.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def covariance_vector(rows: DataFrame, features: Sequence[str], key: str = "head") -> DataFrame:
    """(key, covariance): the covariance matrix, flattened by rows."""
    n = range(len(features))
    return covariance_wide(rows, features, key).select(key, F.array(*[F.col(f"c_{min(i, j)}_{max(i, j)}") for i in n for j in n]).alias("covariance"))


def covariance_eigen(vectors: DataFrame, key: str = "head") -> DataFrame:
    """(key, eigenvalues, eigenvectors) of flattened covariance matrices, largest first; null where a part is null.

    Eigenvectors are of length 1, one array each, their first part that is not 0 above 0; both are real, since the matrices are symmetric.
    """
    @F.pandas_udf("struct<eigenvalues: array<double>, eigenvectors: array<array<double>>>")
    def solved(m: pd.Series) -> pd.DataFrame:
        values, axes = [], []
        for v in m:
            if v is None or any(x is None or not np.isfinite(x) for x in v):
                values.append(None)
                axes.append(None)
                continue
            n = int(round(len(v) ** 0.5))
            w, u = np.linalg.eigh(np.asarray(v, float).reshape(n, n))
            lead = u[np.argmax(np.abs(u) > 1e-12, axis=0), np.arange(n)]
            values.append(w[::-1].tolist())
            axes.append((u * np.where(lead < 0, -1.0, 1.0))[:, ::-1].T.tolist())
        return pd.DataFrame({"eigenvalues": values, "eigenvectors": axes})

    return vectors.select(key, solved("covariance").alias("e")).select(key, "e.*")


def raw_vector(rows: DataFrame, features: Sequence[str], length: int, key: str = "head") -> DataFrame:
    """(key, vector): the fitted matrix of length rows, flattened by rows."""
    fitted = fit_length(rows, length, key)
    return fitted.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", F.array(*features).alias("v")))).alias("s")).select(key, F.flatten(F.transform("s", lambda x: x["v"])).alias("vector"))


def mean_covariance(long: DataFrame) -> DataFrame:
    """(i, j, covariance): element-wise mean over tracklets."""
    return long.groupBy("i", "j").agg(F.avg("covariance").alias("covariance"))
