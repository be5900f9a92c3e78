"""Series statistics by generation: trends, cross-correlation, normality, reports, and scores of windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import analysis, tracklets
from .blocks import ranked
from .lineage import saved
from .space import knn


def polynomial_trend(series: DataFrame, degree: int = 6, key: str = "head") -> DataFrame:
    """(key, i, value, fitted, coefficients) over series (key, i, value): least squares on i centred and scaled to -1 .. 1.

    Sums of powers are one aggregate per key; only the small system of equations is solved in Python.
    """
    ends = series.groupBy(key).agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"))
    u = series.join(ends, key).withColumn("u", F.coalesce((2 * F.col("i") - F.col("_lo") - F.col("_hi")) / F.nullif((F.col("_hi") - F.col("_lo")).cast("double"), F.lit(0.0)), F.lit(0.0)))
    sums = u.groupBy(key).agg(F.array(*[F.sum(F.pow("u", F.lit(k))) for k in range(2 * degree + 1)]).alias("s"), F.array(*[F.sum(F.pow("u", F.lit(k)) * F.col("value")) for k in range(degree + 1)]).alias("t"))

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.array([[a[i + j] for j in range(degree + 1)] for i in range(degree + 1)]), np.asarray(b, float), rcond=1e-10)[0].tolist() for a, b in zip(s, t)])

    fitted = u.join(sums.select(key, solve("s", "t").alias("coefficients")), key)
    value = F.aggregate(F.reverse("coefficients"), F.lit(0.0), lambda acc, c: acc * F.col("u") + c)
    return fitted.select(key, "i", "value", value.alias("fitted"), "coefficients")


def linear_trend(series: DataFrame, key: str = "head") -> DataFrame:
    """(key, slope, intercept) of a straight line per tracklet."""
    return series.groupBy(key).agg(F.regr_slope("value", F.col("i").cast("double")).alias("slope"), F.regr_intercept("value", F.col("i").cast("double")).alias("intercept"))


def cross_correlation(rows: DataFrame, features: Sequence[str], lags: int, key: str = "head") -> DataFrame:
    """(key, feature, lag, ccf): each feature against all others at lags 0 .. lags, normalised, averaged over partners; undefined ones dropped.

    rows are (key, i, features). What stands lag places on comes from windows over a key's rows, so that all pairs and lags take one shuffle by key.
    """
    own = Window.partitionBy(key)
    on = lambda k: own.orderBy("i").rangeBetween(k, k)
    scaled = [((F.col(f) - F.avg(f).over(own)) / F.nullif(F.stddev_pop(f).over(own), F.lit(0.0))).alias(f) for f in features]
    centred = rows.where(F.col(key).isNotNull()).select(key, "i", F.count("*").over(own).alias("n"), *scaled)
    later = [F.struct(F.lit(k).alias("lag"), *[F.sum(f).over(on(k)).alias(f) for f in features]) for k in range(lags + 1)]
    joined = centred.withColumn("_later", F.array(*later)).select("*", F.explode("_later").alias("p")).where(F.col("i").isNotNull() & (F.col("p.lag") < F.col("n")))
    pairs = [(f, g) for f in features for g in features if f != g]
    wide = joined.groupBy(key, F.col("p.lag").alias("lag")).agg(F.first("n").alias("n"), *[F.sum(F.col(f) * F.col(f"p.{g}")).alias(f"c_{f}_{g}") for f, g in pairs])
    long = wide.select(key, "lag", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"c_{f}_{g}") / (F.col("n") - F.col("lag"))).alias("c")) for f, g in pairs])).alias("p"))
    return long.select(key, "lag", "p.*").where("c is not null").groupBy(key, "feature", "lag").agg(F.avg("c").alias("ccf"))


def anderson_darling(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, statistic): distance of the pool from a normal with its mean and sample deviation; null for a constant pool. Ranks come from range partitions, so a pool may hold all rows."""
    @F.pandas_udf("double")
    def log_cdf(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.log(max(0.5 * math.erfc(-x / math.sqrt(2)), 1e-300)))

    rows = saved(values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")), "pool")  # read for the fit, for the range's bounds and for the ranks
    stats = rows.groupBy(*by).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count("*").alias("n")).where("s > 0")
    z = rows.join(stats, list(by)).withColumn("z", (F.col("v") - F.col("m")) / F.col("s"))
    logs = ranked(z, by, ["z"], "r").withColumns({"below": log_cdf("z"), "above": log_cdf(-F.col("z"))})
    total = F.sum((2 * F.col("r") - 1) * F.col("below") + (2 * (F.col("n") - F.col("r")) + 1) * F.col("above"))
    return logs.groupBy(*by, "n").agg((-F.col("n") - total / F.col("n")).alias("statistic"))


def generation_report(rows: DataFrame, spans: DataFrame, features: Sequence[str], lags: int = 5, cell_type: str | None = None) -> DataFrame:
    """(later, kind, feature, tracklets, mean, std, statistic): what first tracklets and later ones are like.

    rows have head, frame, spot_id, generation, features (and cell_type); spans (head, life) bound the tracklets: first ones
    need a life above 0. Kinds: the pooled normalised autocorrelation and the cross-correlation at lags from 1 on, with
    their normal fit and distance from normality; the slope of a straight line; the features' covariances ("a,b"). With a
    cell_type only its tracklets count. Undefined values are left out.
    """
    kept = rows if cell_type is None else rows.where(F.col("cell_type") == cell_type)
    kept = saved(tracklets.numbered(kept).select(*dict.fromkeys(["head", "i", "generation", *features])), "numbered")  # each part below reads it
    group = saved(kept.groupBy("head").agg((F.max("generation") > 0).alias("later")).join(spans.select("head", "life"), "head").where("later or life > 0").select("head", "later"), "tracklets")
    numbered = kept.join(group.select("head"), "head", "left_semi")
    series = [numbered.select("head", "i", F.col(f).alias("value")) for f in features]
    parts = [analysis.autocorrelation(s, lags).where("lag > 0").select("head", F.lit("autocorrelation").alias("kind"), F.lit(f).alias("feature"), F.col("acf").alias("value")) for f, s in zip(features, series)]
    parts += [linear_trend(s).select("head", F.lit("slope").alias("kind"), F.lit(f).alias("feature"), F.col("slope").alias("value")) for f, s in zip(features, series)]
    if len(features) > 1:
        parts.append(cross_correlation(numbered.select("head", "i", *features), features, lags).where("lag > 0").select("head", F.lit("cross-correlation").alias("kind"), "feature", F.col("ccf").alias("value")))
    names = F.array(*map(F.lit, features))
    cov = tracklets.covariance_long(numbered, features).where("i <= j")
    parts.append(cov.select("head", F.lit("covariance").alias("kind"), F.concat_ws(",", F.get(names, F.col("i")), F.get(names, F.col("j"))).alias("feature"), F.col("covariance").alias("value")))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    pool, by = saved(values.where("value is not null").join(group, "head"), "values"), ["later", "kind", "feature"]
    fit = pool.groupBy(*by).agg(F.countDistinct("head").alias("tracklets"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    normal = anderson_darling(pool.where("kind like '%correlation'"), by, "value").drop("n")
    return fit.join(normal, by, "left")


def by_duration(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with `place`: their tracklet's number from 1 in order of life (longest first), then head: the order in which a report lists tracklets."""
    order = ranked(spans.select("head", "life", (-F.col("life")).alias("_short")), [], ["_short", "head"], "place")
    return rows.join(order.select("head", "place"), "head")


def score_windows(rows: DataFrame, features: Sequence[str], length: int, model: Callable[[np.ndarray], np.ndarray], key: str = "head") -> DataFrame:
    """(key, start, label): the user's model over every window: an array (windows, length, features) to a label each, in Arrow batches."""
    windows = tracklets.sliding_windows(rows, length, key).groupBy(key, "start").agg(F.sort_array(F.collect_list(F.struct("k", F.array(*[F.col(f).cast("double") for f in features]).alias("v")))).alias("s"))

    @F.pandas_udf("string")
    def label(flat: pd.Series) -> pd.Series:
        return pd.Series([str(x) for x in model(np.stack([np.asarray(v, float) for v in flat]).reshape(len(flat), length, len(features)))]) if len(flat) else pd.Series([], dtype=str)

    return windows.select(key, "start", label(F.flatten(F.transform("s", lambda x: x["v"]))).alias("label"))


def sample_sources(starts: DataFrame, points: DataFrame, n: int, nearest: bool = True, key: str = "id") -> DataFrame:
    """(key, frame, z, y, x): the n nearest existing points of each start, or n copies of it."""
    if not nearest:
        return starts.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(key, "frame", "z", "y", "x")
    found = knn(starts, points, n, key).select(F.col(f"q_{key}").alias(key), F.col("p_spot_id").alias("spot_id"))
    return found.join(points.select("spot_id", "frame", "z", "y", "x"), "spot_id").select(key, "frame", "z", "y", "x")


def as_tracks(paths: DataFrame, key: str = "id") -> DataFrame:
    """Paths numbered from 0 in order of their key, by ranks over range partitions; rows are not sorted."""
    ids = ranked(paths.select(key).distinct(), [], [key], "path").withColumn("path", F.col("path") - 1)
    return paths.join(ids, key)
