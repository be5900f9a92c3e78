"""A user's encoder over vectors: sent once, built once a worker, fed with whole batches; and class maps."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a model's state, pickled, that are sent to all workers; a larger one is read by the factory itself from a shared store.
MAX_STATE = 1 << 30
#: Classes of a map that is put into the plan as a constant; a larger one is joined.
MAX_CLASSES = 1000

Encoder = Callable[[np.ndarray], np.ndarray]
#: Encoders of this worker by the call that they belong to: a worker outlives its tasks.
_built: dict[str, Encoder] = {}


def _encoder(token: str, build: Callable[[object], Encoder], state: Callable[[], object]) -> Encoder:
    if token not in _built:
        _built.clear()  # one model at a time in a worker's memory
        made = build(state())
        if not callable(made):
            raise TypeError(f"the factory has to give a callable, not {type(made).__name__}")
        _built[token] = made
    return _built[token]


def encode(rows: DataFrame, build: Callable[[object], Encoder], state: object = None, width: int | None = None, vector: str = "vector", out: str = "latent") -> DataFrame:
    """rows plus `out`: what the encoder makes of their vectors, an array<double> of one width.

    build(state) is called once in each Python worker, on its first batch; state (weights, a path) is sent once to each
    executor, not with each task. The encoder gets a matrix of a batch's vectors, a row each, and has to give a matrix with as many rows
    of finite or infinite numbers and `width` columns (any, if it is not given). Null vectors, and those that hold a null, have a null latent and are not shown to it; vectors of
    different lengths within one batch, or an answer of another shape or kind, raise. An empty table gives no rows.
    """
    if len(pickle.dumps(state)) > MAX_STATE:
        raise ValueError(f"a model's state of over {MAX_STATE} bytes is not sent; let the factory read it from a shared store")
    token, sent = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(state)

    @F.pandas_udf("array<double>")
    def latent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(token, build, lambda: sent.value)
        for batch in batches:
            known = batch.notna()
            result = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if known.any():
                widths = {len(v) for v in batch[known]}
                if len(widths) > 1:
                    raise ValueError(f"vectors of different lengths: {sorted(widths)}")
                given = np.array([np.asarray(v, float) for v in batch[known]])
                got = np.asarray(encoder(given))
                if got.ndim != 2 or got.shape[0] != len(given) or (width is not None and got.shape[1] != width) or not np.issubdtype(got.dtype, np.number) or np.iscomplexobj(got):
                    raise TypeError(f"the encoder gave {got.dtype} of shape {got.shape} for {len(given)} vectors{'' if width is None else f' of width {width}'}")
                result[known] = pd.Series(list(got.astype(float)), index=batch.index[known])
            yield result

    return rows.withColumn(out, latent(F.when(F.forall(vector, lambda x: x.isNotNull()), F.col(vector))))


def linear(weights: np.ndarray) -> Encoder:
    """A factory for encode(): vectors times a matrix (its state), one column of it for each part of the latent."""
    matrix = np.asarray(weights, float)
    return lambda x: x @ matrix


def map_classes(rows: DataFrame, names: Mapping[object, object] | DataFrame, column: str = "label", out: str = "class_name", default: object = None) -> DataFrame:
    """rows plus `out`: the name (or number) that a class map gives the column's value; `default` where it gives none.

    A small mapping is a constant of the plan; a table (from, to), or a larger mapping, is joined, and Spark broadcasts it
    only below its own size limit. A null value maps only if the map has a null; of several rows for a value the smallest name counts.
    """
    if not isinstance(names, DataFrame):
        if len(names) <= MAX_CLASSES and None not in names:
            if not names:
                return rows.withColumn(out, F.lit(default))
            pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
            return rows.withColumn(out, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(default)))
        names = rows.sparkSession.createDataFrame(list(names.items()), ["from", "to"])
    one = names.groupBy(F.col("from").alias("_from")).agg(F.min("to").alias("_to"))
    return rows.join(one, F.col(column).eqNullSafe(F.col("_from")), "left").withColumn(out, F.coalesce("_to", F.lit(default))).drop("_from", "_to")


def reversed_map(names: Mapping[object, object]) -> dict[object, object]:
    """Names back to classes; of classes with one name the smallest."""
    out: dict[object, object] = {}
    for k, v in sorted(names.items()):
        out.setdefault(v, k)
    return out


def encoded_as(column: Column, places: int = 6) -> Column:
    """A latent with its parts rounded, without a negative zero."""
    return F.transform(column, lambda x: F.round(x, places) + 0.0)
