"""Clustering and evaluation of vectors: pairwise distances in a group, threshold components, k-means families, scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .blocks import in_blocks
from .lineage import saved


#: Blocks of a side that a pair of wide blocks takes together, where what comes of a pair is a row for a row: each row is copied so many times less.
WIDE = 16
#: Part of two vectors' squared lengths under which a squared distance is made from differences.
NEAR = 1e-4
#: A user's metric: matrices (n, d) and (m, d) to the distances (n, m).
Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def vector_distance(a: Column, b: Column, metric: str = "euclidean", skip: int = 0) -> Column:
    """Euclidean or cosine distance of two array<double>; cosine is 0 where a norm is 0; skip leaves out leading parts."""
    if skip:
        a, b = (F.slice(x, skip + 1, F.size(x)) for x in (a, b))
    if metric == "cosine":
        norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
        return F.coalesce(1 - _dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def pairwise_distance(vectors: DataFrame, by: Sequence[str], metric: str = "euclidean", key: str = "id") -> DataFrame:
    """(by, a, b, distance) of all pairs a < b within a group: that is the result that it is asked for. What only needs near pairs, sums or the nearest goes by in_blocks().

    Pairs of blocks are compared as matrices. Vectors that are null, not of the usual length, or hold nulls or parts that are not finite (or whose
    squares might not be) are joined one by one.
    """
    rows = vectors.select(*by, F.col(key).alias("id"), "vector").where(" and ".join(f"`{c}` is not null" for c in (*by, "id")))
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))
    usual = rows.where(finite).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    plain = finite & (F.size("vector") == (usual["n"] if usual else -1))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.select(*by, F.col("id").alias("a"), F.col("vector").alias("_u")), right.select(*by, F.col("id").alias("b"), F.col("vector").alias("_v"))
        return a.join(b, list(by)).where("a < b").select(*by, "a", "b", vector_distance(F.col("_u"), F.col("_v"), metric).alias("distance"))

    found, odd = pairwise_metric(rows.where(plain), by, metric), rows.where(~plain)
    return found if odd.isEmpty() else found.unionByName(joined(odd, rows)).unionByName(joined(rows.where(plain), odd))


def pairwise_metric(vectors: DataFrame, by: Sequence[str], metric: str | Metric, symmetric: bool = True, key: str = "id") -> DataFrame:
    """(by, a, b, distance) of the pairs within a group by a user's metric: all a < b if it is symmetric, else all a <> b.

    The metric gets two matrices, a row per vector, and gives the matrix of distances of each of the first from each of the second; it is
    called for pairs of blocks. One that says it is symmetric is called for one order of two blocks only. Vectors have one length; none is null.
    """
    rows = vectors.select(*by, F.col(key).alias("id"), "vector")

    def pairs(x: pd.DataFrame, y: pd.DataFrame, one: bool = False) -> pd.DataFrame:
        d, left, right = matrix(x["vector"], y["vector"], metric), x["id"].to_numpy(), y["id"].to_numpy()
        keep = left[:, None] < right[None, :] if symmetric and one else left[:, None] != right[None, :]
        u, v = np.nonzero(keep)
        a, b = left[u], right[v]
        if symmetric:
            a, b = np.where(a < b, a, b), np.where(a < b, b, a)
        out = pd.DataFrame({c: np.repeat(x[c].to_numpy()[:1], len(u)) for c in by})
        return out.assign(a=a, b=b, distance=d[u, v])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"a {kinds['id']}", f"b {kinds['id']}", "distance double"])
    return in_blocks(rows, rows, by, pairs, schema, half=symmetric)


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cluster): smallest id reachable over edges (a, b); smallest neighbour's label and pointer jumping in turn, each round written."""
    both = saved(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "edges")
    state = saved(nodes.select("id", F.col("id").alias("cluster")), "clusters")
    while True:
        near = both.join(state, both.v == state.id).groupBy("u").agg(F.min("cluster").alias("near"))
        step = state.join(near, state.id == near.u, "left").select("id", F.col("cluster").alias("old"), F.least("cluster", "near").alias("cluster"))
        new = saved(step.join(step.select(F.col("id").alias("_r"), F.col("cluster").alias("_c")), F.col("cluster") == F.col("_r")).select("id", "old", F.least("cluster", "_c").alias("cluster")), "clusters")
        state = new.select("id", "cluster")
        if new.where("old <> cluster").isEmpty():
            return state


def matrix(a: pd.Series, b: pd.Series, metric: str | Metric = "euclidean") -> np.ndarray:
    """Distances of every vector of a from every vector of b, as vector_distance() has them, or as a user's metric gives them."""
    u, v = np.array(a.tolist(), float), np.array(b.tolist(), float)
    if callable(metric):
        d = np.asarray(metric(u, v), float)
        if d.shape != (len(u), len(v)):
            raise TypeError(f"the metric gave a shape of {d.shape} for {len(u)} and {len(v)} vectors")
        return d
    if metric == "cosine":
        norms = np.sqrt((u * u).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
        return np.where(norms > 0, 1 - (u @ v.T) / np.where(norms > 0, norms, 1), 0.0)
    return np.sqrt(np.maximum(np.array([((v - row) ** 2).sum(axis=1) for row in u]), 0.0))


def _lengths(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product; those that are small beside the lengths, which it would round, are made from the differences."""
    a, b = (u * u).sum(axis=1)[:, None], (v * v).sum(axis=1)[None, :]
    square = a + b - 2 * (u @ v.T)
    i, k = np.nonzero(square < NEAR * (a + b))
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        square[i[s], k[s]] = ((u[i[s]] - v[k[s]]) ** 2).sum(axis=1)
    return np.sqrt(square)


def skipping(metric: str, skip: int) -> Metric:
    """The metric of what is left of the vectors without their `skip` leading parts."""
    return lambda u, v: matrix(pd.Series(list(u[:, skip:])), pd.Series(list(v[:, skip:])), metric)


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """Few links (a, b) that join the same rows as all links of a block's matrix: labels spread over it until they rest, then each row names its label's."""
    every = np.concatenate((left, right))
    n, own = len(left), np.arange(len(left) + len(right))
    label = own.copy()
    while True:
        low = np.where(near, label[n:][None, :], len(every)).min(axis=1, initial=len(every))
        mine = np.minimum(label[:n], low)
        high = np.minimum(label[n:], np.where(near, mine[:, None], len(every)).min(axis=0, initial=len(every)))
        new = np.concatenate((mine, high))
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != own)
    out = pd.DataFrame({"a": every[label[at]], "b": every[at]})
    return out[out["a"] != out["b"]]


def homes(rows: DataFrame, by: Sequence[str], carry: Sequence[str] = (), size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (by, id, at, carry) as (by, ball, id, at, carry, d), each in the ball of its nearest pivot, and the balls (by, ball, id, at: the pivot, radius, n).

    A group's pivots are about the square root of its rows, drawn by a hash (one, where a block holds the group).
    """
    size, kinds = size or blocks.BLOCK, dict(rows.dtypes)
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min(F.struct(F.xxhash64("id"), "id", "at")).alias("_one"))
    wanted = F.when(F.col("_n") <= size, F.lit(0)).otherwise(F.ceil(F.sqrt("_n")))
    drawn = rows.join(n.select(*by, "_n"), list(by)).where(F.pmod(F.xxhash64(F.lit(7), "id"), F.col("_n")) < wanted).select(*by, "id", "at")
    pivots = saved(drawn.unionByName(n.select(*by, "_one.id", "_one.at")).dropDuplicates([*by, "id"]).withColumnRenamed("id", "ball"), "pivots").withColumn("id", F.col("ball"))

    def home(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = matrix(x["at"], y["at"])
        k = d.argmin(axis=1)
        return x.assign(ball=y["ball"].to_numpy()[k], d=d[np.arange(len(x)), k])

    fields = [*by, "id", "at", *carry]
    schema = ", ".join(f"{c} {kinds[c]}" for c in fields)
    mine = in_blocks(rows.select(*fields), pivots, by, home, f"{schema}, ball {kinds['id']}, d double")
    mine = saved(mine.groupBy(*by, "id").agg(F.min_by(F.struct("at", *carry, "ball", "d"), F.struct("d", "ball")).alias("h")).select(*by, "id", "h.*"), "homes")
    return mine, pivots.join(mine.groupBy(*by, "ball").agg(F.max("d").alias("radius"), F.count("*").alias("n")), [*by, "ball"])


def in_balls(rows: DataFrame, by: Sequence[str], limit: float, size: int | None = None) -> DataFrame:
    """rows (by, id, vector, at) as (by, ball, home, id, vector, at): each row in its own ball, and in those that may hold a row within limit of it.

    `at` is the vector by which rows are near, in euclidean distance. By the triangle inequality only a ball whose pivot is no further
    than its radius plus limit can hold a row within limit; of two balls, rows of the one with the smaller pivot visit the other. So near
    rows meet in one ball, and rows of far balls never do.
    """
    kinds = dict(rows.dtypes)
    mine, wide = homes(rows, by, ["vector"], size)

    def visits(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d, reach = matrix(x["at"], y["at"]), (y["radius"].to_numpy() + limit) * (1 + 1e-9) + 1e-12
        u, v = np.nonzero((d <= reach[None, :]) & (x["ball"].to_numpy()[:, None] < y["ball"].to_numpy()[None, :]))
        out = pd.DataFrame({c: x[c].to_numpy()[u] for c in (*by, "id")})
        return out.assign(ball=y["ball"].to_numpy()[v])

    group = "".join(f"{c} {kinds[c]}, " for c in by)
    other = in_blocks(mine.select(*by, "ball", "id", "at"), wide, by, visits, f"{group}ball {kinds['id']}, id {kinds['id']}")
    same = [F.col(f"_o.{c}").eqNullSafe(F.col(f"_m.{c}")) for c in by] + [F.col("_o.id") == F.col("_m.id")]
    other = other.alias("_o").join(mine.alias("_m"), same).select(*[f"_o.{c}" for c in (*by, "ball")], F.lit(False).alias("home"), "_m.id", "_m.vector", "_m.at")  # a row's vectors leave Spark once, not once a ball
    return saved(other.unionByName(mine.select(*by, "ball", F.lit(True).alias("home"), "id", "vector", "at")), "balls")


def near_pairs(vectors: DataFrame, by: Sequence[str], limit: float, metric: str = "euclidean") -> DataFrame:
    """(by, a, b, distance) of the pairs a < b within a group that are closer than limit, by balls: the pairs of far balls are never compared.

    metric is euclidean or cosine. A vector without length is at cosine distance 0 from all of its group, so it pairs with each. Null vectors pair with nothing.
    """
    rows = vectors.where("vector is not null").select(*by, F.lit(0).alias("_all"), "id", "vector")
    kinds, at, empty, inner = dict(rows.dtypes), F.col("vector"), None, [*by, "_all"]
    if metric == "cosine":
        rows = rows.withColumn("_length", F.sqrt(_dot(F.col("vector"), F.col("vector"))))
        hubs = rows.where("_length = 0").select(*inner, F.col("id").alias("_hub"))
        with_hub = hubs.join(rows.select(*inner, "id", "_length"), inner).where("(_length > 0 and id <> _hub) or _hub < id")
        empty = with_hub.select(*by, F.least("id", "_hub").alias("a"), F.greatest("id", "_hub").alias("b"), F.lit(0.0).alias("distance")) if limit > 0 else None
        rows, at = rows.where("_length > 0"), F.transform("vector", lambda x: x / F.col("_length"))
    placed = in_balls(rows.select(*inner, "id", "vector", at.alias("at")), inner, math.sqrt(2 * max(limit, 0.0)) if metric == "cosine" else limit)

    def pairs(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d, left, right = matrix(x["vector"], y["vector"], metric), x["id"].to_numpy(), y["id"].to_numpy()
        u, v = np.nonzero((d < limit) & np.where(x["home"].to_numpy()[:, None], left[:, None] < right[None, :], left[:, None] != right[None, :]))
        a, b = left[u], right[v]
        out = pd.DataFrame({c: [x[c].iloc[0]] * len(u) for c in by})
        return out.assign(a=np.where(a < b, a, b), b=np.where(a < b, b, a), distance=d[u, v])

    group = "".join(f"{c} {kinds[c]}, " for c in by)
    found = in_blocks(placed.drop("at"), placed.where("home").drop("at", "home"), [*inner, "ball"], pairs, f"{group}a {kinds['id']}, b {kinds['id']}, distance double")
    return found if empty is None else found.unionByName(empty)


def threshold_clusters(vectors: DataFrame, by: Sequence[str], limit: float, metric: str | Metric = "euclidean") -> DataFrame:
    """(id, cluster): components of pairs closer than limit: the single-linkage tree cut at that distance.

    For euclidean and cosine distances only rows of balls that may hold near rows meet (in_balls(); cosine by unit vectors, where
    a distance d is the root of 2 d apart, and vectors without length, 0 from all, link their whole group). A user's metric,
    which need not keep the triangle inequality, meets all pairs of blocks. Blocks are compared as matrices, and give one link to each row that is near some other.
    """
    def links(x: pd.DataFrame, y: pd.DataFrame, one: bool = False) -> pd.DataFrame:
        return _spanning(matrix(x["vector"], y["vector"], metric) < limit, x["id"].to_numpy(), y["id"].to_numpy())

    rows, by = vectors.select(*by, F.lit(0).alias("_all"), "id", "vector"), [*by, "_all"]
    kind = dict(rows.dtypes)["id"]
    if callable(metric):
        return connected(in_blocks(rows, rows, by, links, f"a {kind}, b {kind}", half=True), vectors)
    at, empty = F.col("vector"), None
    if metric == "cosine":
        length = F.sqrt(_dot(F.col("vector"), F.col("vector")))
        rows = rows.withColumn("_length", length)
        if limit > 0:
            hubs = rows.where("_length = 0").groupBy(*by).agg(F.min("id").alias("a"))
            empty = hubs.join(rows, list(by)).select("a", F.col("id").alias("b"))
        rows = rows.where("_length > 0")
        at = F.transform("vector", lambda x: x / F.col("_length"))
    placed = in_balls(rows.select(*by, "id", "vector", at.alias("at")), by, math.sqrt(2 * max(limit, 0.0)) if metric == "cosine" else limit)
    found = in_blocks(placed.drop("at", "home"), placed.where("home").drop("at", "home"), [*by, "ball"], links, f"a {kind}, b {kind}")
    return connected(found if empty is None else found.unionByName(empty), vectors)


def k_clusters(vectors: DataFrame, k: int, metric: str = "euclidean", seed: int = 1, bisecting: bool = False) -> DataFrame:
    """vectors plus cluster, by k-means or bisecting k-means."""
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, distanceMeasure=metric, featuresCol="_f", predictionCol="cluster")
    rows = vectors.withColumn("_f", array_to_vector("vector"))
    return model.fit(rows).transform(rows).drop("_f")


def centroids(rows: DataFrame, label: str = "cluster") -> DataFrame:
    """(label, vector): mean vector of each label."""
    long = rows.select(label, F.posexplode("vector").alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"))
    return long.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector"))


def _to_centre(rows: DataFrame, label: str, few: bool = False) -> DataFrame:
    centres = centroids(rows, label).withColumnRenamed("vector", "_m")
    return rows.join(F.broadcast(centres) if few else centres, label).withColumn("_d", vector_distance(F.col("vector"), F.col("_m")))


def wcss(rows: DataFrame, label: str = "cluster") -> DataFrame:
    """(wcss): sum of squared distances to the own centroid."""
    return _to_centre(rows, label).agg(F.sum(F.col("_d") * F.col("_d")).alias("wcss"))


def spread(rows: DataFrame, label: str = "cluster", few: bool = False) -> DataFrame:
    """(label, spread): mean distance to the label's mean."""
    return _to_centre(rows, label, few).groupBy(label).agg(F.avg("_d").alias("spread"))


def position_spread(rows: DataFrame, label: str = "cluster", axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """(label, spread): mean distance of the label's places to their mean."""
    return spread(rows.where(F.col(label).isNotNull()).select(label, F.array(*[F.col(c).cast("double") for c in axes]).alias("vector")), label, True)  # cell types are few: their middles go to all


def label_sums(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, total, square, held): rows, sum of vectors, sum of squared lengths and rows with a length, of each label; sums are added by part, so a large label is no one task's."""
    long = rows.select(label, F.posexplode("vector").alias("i", "v")).groupBy(label, "i").agg(F.sum("v").alias("v"))
    total = long.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("total"))
    square = _dot(F.col("vector"), F.col("vector"))
    counts = rows.groupBy(label).agg(F.count("*").alias("n"), F.sum(square).alias("square"), F.count_if(square > 0).alias("held"))
    return counts.join(total, label)


def silhouette(rows: DataFrame, metric: str = "euclidean", label: str = "cluster", key: str = "id") -> DataFrame:
    """(silhouette): mean over rows of (nearest other label's mean distance - own) / the larger; 0 for labels of one row.

    metric is euclidean, squared (squared euclidean) or cosine. The mean squared or cosine distance from a label follows from its count and sums, so
    those two take rows times labels. A mean euclidean distance doesn't; it lies between the distance from the label's
    mean and the root of the mean squared distance. So for each row only the labels whose lower bound is under the
    smallest upper bound are met, and its own: pairs of wide blocks, in parts as matrices, whose sums are added up. No pair is a row.
    """
    flat = rows.select(F.col(key).alias("id"), F.when(F.col(label).isNotNull(), F.xxhash64(label)).alias("label"), "vector").where("label is not null")
    if metric == "cosine":
        length = F.sqrt(_dot(F.col("vector"), F.col("vector")))
        flat = flat.withColumn("_length", length).withColumn("vector", F.when(F.col("_length") > 0, F.transform("vector", lambda x: x / F.col("_length"))).otherwise(F.col("vector"))).drop("_length")
    else:  # about their mean, so that squares far from 0 don't swallow the distances
        middle = flat.select(F.posexplode("vector").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()  # one number for each part of a vector
        flat = flat.withColumn("vector", F.zip_with("vector", F.array(*[F.lit(r.v) for r in middle]), lambda x, m: x - m))
    flat = saved(flat.withColumn("_all", F.lit(0)), "labelled")
    sums = saved(label_sums(flat), "labels").withColumns({"_all": F.lit(0), "id": F.col("label")})
    kind = dict(flat.dtypes)["id"]

    def squares(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of (squared or cosine) distances of rows from all rows of labels, the labels' counts without the row itself, and whether a label is its own."""
        u, s = np.array(x["vector"].tolist(), float), np.array(y["total"].tolist(), float)
        own = x["label"].to_numpy()[:, None] == y["label"].to_numpy()[None, :]
        n = y["n"].to_numpy()[None, :] - own
        if metric == "cosine":
            held = (u * u).sum(axis=1) > 0
            return np.where(held[:, None], y["held"].to_numpy()[None, :] - u @ s.T, 0.0), n, own
        total = y["n"].to_numpy()[None, :] * (u * u).sum(axis=1)[:, None] - 2 * u @ s.T + y["square"].to_numpy()[None, :]
        return np.maximum(total, 0.0), n, own

    def means(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        total, n, own = squares(x, y)
        with np.errstate(all="ignore"):
            d = np.where(n > 0, total / n, np.nan)
        a = np.where(own, d, np.nan)
        b = np.where(own, np.inf, np.where(np.isnan(d), np.inf, d)).min(axis=1)
        return pd.DataFrame({"id": x["id"], "a": np.where(np.isnan(a).all(axis=1), np.nan, np.nansum(a, axis=1)), "b": np.where(np.isinf(b), np.nan, b)})

    def needed(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        total, n, own = squares(x, y)
        count, s = y["n"].to_numpy()[None, :], np.array(y["total"].tolist(), float)
        low = matrix(x["vector"], pd.Series(list(s / y["n"].to_numpy()[:, None])))
        high = np.sqrt(total / count)
        cut = np.where(own, np.inf, high).min(axis=1)
        u, v = np.nonzero(own | (low <= cut[:, None] * (1 + 1e-9) + 1e-9))
        out = x.iloc[u].reset_index(drop=True)
        return pd.DataFrame({"id": out["id"], "own": out["label"], "vector": out["vector"], "label": y["label"].to_numpy()[v], "low": low[u, v], "high": np.where(own[u, v], np.inf, high[u, v])})

    def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        u, v, mine, theirs = np.array(x["vector"].tolist(), float), np.array(y["vector"].tolist(), float), x["id"].to_numpy(), y["id"].to_numpy()
        total, n, step = np.zeros(len(u)), np.zeros(len(u), int), blocks.BLOCK
        for i in range(0, len(u), step):
            for k in range(0, len(v), step):
                d = _lengths(u[i : i + step], v[k : k + step])
                d[mine[i : i + step, None] == theirs[None, k : k + step]] = np.nan  # a row is no neighbour of its own
                total[i : i + step] += np.nansum(d, axis=1)
                n[i : i + step] += (~np.isnan(d)).sum(axis=1)
        return pd.DataFrame({"id": x["id"], "own": x["own"], "label": x["label"], "total": total, "n": n})

    if metric == "euclidean":
        wanted = in_blocks(flat, sums, ["_all"], needed, f"id {kind}, own long, vector array<double>, label long, low double, high double")
        least = F.min("high").over(Window.partitionBy("id"))  # labels come in blocks too
        wanted = saved(wanted.withColumn("_least", least).where((F.col("own") == F.col("label")) | (F.col("low") <= F.col("_least") * (1 + 1e-9) + 1e-9)).select("id", "own", "vector", "label"), "wanted")
        found = in_blocks(wanted, flat.select("id", "label", "vector"), ["label"], met, f"id {kind}, own long, label long, total double, n long", size=WIDE * blocks.BLOCK)
        each = found.groupBy("id", "own", "label").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
        both = each.groupBy("id").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("own"), F.col("d"))).alias("b"))
    else:
        found = in_blocks(flat, sums, ["_all"], means, f"id {kind}, a double, b double")
        both = found.groupBy("id").agg(F.max(F.nanvl("a", F.lit(None).cast("double"))).alias("a"), F.min(F.nanvl("b", F.lit(None).cast("double"))).alias("b"))
    return both.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("silhouette"))


def choose_k(vectors: DataFrame, ks: Sequence[int], metric: str = "euclidean", seed: int = 1) -> tuple[int | None, DataFrame | None]:
    """The k of the best silhouette above 0 and its rows; None if there is none."""
    best, chosen, rows = 0.0, None, None
    for k in ks:
        found = saved(k_clusters(vectors, k, metric, seed), "k")
        score = silhouette(found, metric).first()[0] or 0.0
        if score > best:
            best, chosen, rows = score, k, found
    return chosen, rows


def labels_to_rows(rows: DataFrame, labelled: DataFrame, key: str = "head") -> DataFrame:
    """rows with the cluster (and its spread) of their tracklet: labelled is (key, cluster, vector)."""
    return rows.join(labelled.select(key, "cluster").join(spread(labelled), "cluster"), key, "left")


def three_view_clusters(views: dict[str, DataFrame], k: int, metric: str = "euclidean", seed: int = 1) -> DataFrame:
    """(view, measured_in, cluster, spread): the clusters of each view (id, vector), and how wide they are in each of the views."""
    out = None
    for name, vectors in views.items():
        labels = saved(k_clusters(vectors, k, metric, seed).select("id", "cluster"), "view")
        for other, space in views.items():
            one = spread(space.join(labels, "id")).select(F.lit(name).alias("view"), F.lit(other).alias("measured_in"), "cluster", "spread")
            out = one if out is None else out.unionByName(one)
    return out


def nearest_vectors(rows: DataFrame, labelled: DataFrame, k: int, by: Sequence[str] = (), label: str = "label", metric: str | Metric = "euclidean") -> DataFrame:
    """(id, other, label, d): the k nearest labelled vectors of the same group (without by: of all) of each row, itself left out; ties by the smaller id.

    Labelled vectors lie in balls. All of a ball is within its pivot's distance plus its radius, none of it nearer than that distance less the radius; so the balls that
    come first by the former until k + 1 are in them tell how far a row has to look, and it meets only balls that begin within. Balls are compared as matrices; each row
    keeps its k best of each ball, then its k best of those. A user's metric, which need not keep the triangle inequality, meets all blocks.
    Equal rows ask as one, for one more than k, and leave themselves out afterwards; of equal labelled vectors only the first k + 1 ids can be among those.
    """
    group = [*by, "_all"]
    members = saved(rows.select(*by, F.lit(0).alias("_all"), "id", "vector").withColumn("_asks", F.min("id").over(Window.partitionBy(*group, "vector"))), "members")
    a = members.where(F.col("id") == F.col("_asks")).select(*group, "id", "vector")
    b = labelled.select(*by, F.lit(0).alias("_all"), "id", F.col("vector").alias("at"), F.col(label).alias("label"))
    b = b.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "at").orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r")
    b = saved(b, "labelled")
    kind, other = dict(a.dtypes), dict(b.dtypes)
    keys = "".join(f"{c} {kind[c]}, " for c in group)

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("id")
        d = matrix(x["vector"], y["at"], metric)
        at = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
        row = np.repeat(np.arange(len(x)), at.shape[1])
        out = pd.DataFrame({"id": x["id"].to_numpy()[row], "other": y["id"].to_numpy()[at.ravel()], "label": y["label"].to_numpy()[at.ravel()], "d": d[row, at.ravel()]})
        return out[np.isfinite(out["d"])]

    def visits(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d, r = matrix(x["vector"], y["at"]), y["radius"].to_numpy()[None, :]
        far, near = (d + r) * (1 + 1e-9) + 1e-12, np.maximum((d - r) * (1 - 1e-9) - 1e-12, 0.0)
        order = np.argsort(far, axis=1)
        held = np.cumsum(y["n"].to_numpy()[order], axis=1)
        enough = np.where(held >= k + 1, np.take_along_axis(far, order, axis=1), np.inf).min(axis=1)
        u, v = np.nonzero(near <= enough[:, None])
        out = pd.DataFrame({c: x[c].to_numpy()[u] for c in (*group, "id")})
        return out.assign(ball=y["ball"].to_numpy()[v], near=near[u, v], enough=enough[u])

    result = f"id {kind['id']}, other {other['id']}, label {other['label']}, d double"
    if callable(metric):
        met = in_blocks(a, b, group, best, result)
    else:
        mine, wide = homes(b, group, ["label"])
        asked = in_blocks(a, wide, group, visits, f"{keys}id {kind['id']}, ball {other['id']}, near double, enough double")
        least = F.min("enough").over(Window.partitionBy(*group, "id"))  # pivots come in blocks too
        same = [F.col(f"_o.{c}").eqNullSafe(F.col(f"_a.{c}")) for c in group] + [F.col("_o.id") == F.col("_a.id")]
        asked = asked.withColumn("_least", least).where("near <= _least").alias("_o").join(a.alias("_a"), same)
        asked = saved(asked.select(*[f"_o.{c}" for c in (*group, "id")], "_a.vector", "_o.ball"), "asked")
        met = in_blocks(asked, mine.select(*group, "ball", "id", "at", "label"), [*group, "ball"], best, result)
    first = lambda df, n: df.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).where(F.col("_r") <= n).drop("_r")
    found = first(met, k + 1).withColumnRenamed("id", "_asks")
    return first(members.select("id", "_asks").join(found, "_asks").where("id <> other").select("id", "other", "label", "d"), k)


def classify_knn(rows: DataFrame, labelled: DataFrame, k: int, by: Sequence[str] = (), label: str = "label", metric: str | Metric = "euclidean") -> DataFrame:
    """(id, label): the commonest label among the k nearest labelled vectors (nearest_vectors()); ties by the smaller label."""
    votes = nearest_vectors(rows, labelled, k, by, label, metric).groupBy("id", "label").agg(F.count("*").alias("n"))
    return votes.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "label"))).where("_r = 1").select("id", F.col("label").alias(label))


def classify_forest(rows: DataFrame, labelled: DataFrame, label: str = "label", trees: int = 50, seed: int = 1) -> DataFrame:
    """rows plus prediction, by a random forest fitted on labelled (vector, label: whole numbers from 0)."""
    from pyspark.ml.classification import RandomForestClassifier

    vector = lambda df: df.withColumn("_f", array_to_vector("vector"))
    model = RandomForestClassifier(featuresCol="_f", labelCol=label, numTrees=trees, seed=seed).fit(vector(labelled))
    return model.transform(vector(rows)).drop("_f", "rawPrediction", "probability")
