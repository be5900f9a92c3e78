"""Work that goes over the pairs or the order of many rows, in pieces of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import saved

#: Rows of one side in a block, so that a pair of blocks fits a task.
BLOCK = 1024


def in_blocks(rows: DataFrame, others: DataFrame, by: Sequence[str], make: Callable[..., pd.DataFrame], schema: str, key: str = "id", size: int | None = None, half: bool = False) -> DataFrame:
    """make(block of rows, block of others) for every pair of blocks of each group, as one table.

    Both sides are dealt to blocks by a hash of their key; each group has as many blocks as its own rows need, so a task
    has about `size` rows of either side, and a small group is copied no more often than it has to be. No pair of rows is a row:
    make() gives what it finds. Groups that only one side has give nothing; null is a group. With half, both sides have to be the same rows: of two blocks only one
    order is made, and make() gets a third argument, whether the two are one block.
    """
    size = size or BLOCK

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)]).agg(F.ceil(F.count("*") / size).cast("long").alias(name))

    keyed = [f"_by_{i}" for i in range(len(by))]
    same = lambda x, y: [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(x, y)]
    p, q = parts(rows, "_m"), parts(others, "_n")
    sizes = saved(p.join(q.withColumnsRenamed({k: f"{k}_" for k in keyed}), same(keyed, [f"{k}_" for k in keyed])).select(*keyed, "_m", "_n"), "blocks")
    block = lambda n: F.pmod(F.xxhash64(F.col(n), F.col(key)), F.col(n))
    zero = F.lit(0).cast("long")
    a = rows.join(sizes, same(by, keyed)).withColumn("_p", block("_m")).withColumn("_q", F.explode(F.sequence(F.col("_p") if half else zero, F.col("_n") - 1))).drop("_m", "_n", *keyed)
    b = others.join(sizes, same(by, keyed)).withColumn("_q", block("_n")).withColumn("_p", F.explode(F.sequence(zero, F.col("_q") if half else F.col("_m") - 1))).drop("_m", "_n", *keyed)
    b = b.select(*[F.col(c).alias(f"o_{c}") for c in (*others.columns, "_p", "_q")])  # names of their own: both sides may be one table
    keys, names, back = [*by, "_p", "_q"], [c.split()[0] for c in schema.split(", ")], {f"o_{c}": c for c in others.columns}

    def both(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        more = (bool(x["_p"].iloc[0] == x["_q"].iloc[0]),) if half else ()
        return make(x.drop(columns=["_p", "_q"]), y.drop(columns=["o__p", "o__q"]).rename(columns=back), *more)

    return a.groupBy(*keys).cogroup(b.groupBy(*[f"o_{c}" for c in keys])).applyInPandas(both, schema)


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """rows plus their number (from 1) in order within each group, however large a group is: range partitions, numbered within, offset by the counts before."""
    dealt = saved(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))  # one row per group and partition that it is in
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda c: F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))
    joined = dealt.alias("_l").join(counts.withColumn("_before", before).drop("_n").alias("_r"), [same(c) for c in (*by, "_part")]).select("_l.*", "_r._before")
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return joined.withColumn(name, (F.col("_before") + within).cast("long")).drop("_part", "_before")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column per share): exact quantiles of non-null values, interpolated between neighbours in order; no group is held in one place."""
    placed = ranked(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), by, ["_v"], "_rank")
    sizes = placed.groupBy(*by).agg(F.count("*").alias("_n"))
    wanted = {n: 1 + (F.col("_n") - 1) * F.lit(float(s)) for n, s in shares.items()}
    near: Column = F.lit(False)
    for at in wanted.values():
        near = near | (F.col("_rank") == F.floor(at)) | (F.col("_rank") == F.ceil(at))
    few = placed.join(sizes, list(by)).where(near) if by else placed.crossJoin(F.broadcast(sizes)).where(near)
    pick = lambda at, f: F.max(F.when(F.col("_rank") == f(at), F.col("_v")))
    low = few.groupBy(*by).agg(*[x.alias(f"{n}_{k}") for n, at in wanted.items() for k, x in (("lo", pick(at, F.floor)), ("hi", pick(at, F.ceil)), ("at", F.max(at - F.floor(at))))])
    return low.select(*by, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_at")).alias(n) for n in shares])


def before_in_order(rows: DataFrame, by: Sequence[str], order: str, values: Sequence[str], size: int = 65_536) -> DataFrame:
    """rows plus prior_<value>: the values of the row before it in its group, by a whole-number order; windows are over runs of `size` numbers.

    The first row of a run takes its values from the last row of the run before it, of which there is one row per run.
    """
    cut = rows.withColumn("_run", F.floor(F.col(order) / size))
    w = Window.partitionBy(*by, "_run").orderBy(order)
    last = cut.groupBy(*by, "_run").agg(F.max_by(F.struct(*values), order).alias("_end"))
    last = last.select(*by, "_run", F.lag("_end").over(Window.partitionBy(*by).orderBy("_run")).alias("_end"))
    first = F.row_number().over(w) == 1
    joined = cut.withColumns({"_first": first, **{f"prior_{c}": F.lag(c).over(w) for c in values}}).join(last, [*by, "_run"])
    return joined.withColumns({f"prior_{c}": F.when(F.col("_first"), F.col(f"_end.{c}")).otherwise(F.col(f"prior_{c}")) for c in values}).drop("_run", "_first", "_end")
