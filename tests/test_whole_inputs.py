"""Registered queries answer for all of their input, not for a prefix or a remainder of it."""

from collections import Counter

import numpy as np
import pytest

from strandwork.plans import registry


@pytest.mark.parametrize("name", ["distance_to_boundary", "label_density"])
def test_every_spot(spark, sf, name):
    spots = {r.spot_id for r in registry.QUERIES["scale_values"](spark, sf).select("spot_id").collect()}
    found = [r.spot_id for r in registry.QUERIES[name](spark, sf).select("spot_id").collect()]
    assert len(found) == len(spots) and set(found) == spots


def test_nearest_of_all_labelled(spark, sf):
    """Votes of the three nearest of all labelled vectors, by numpy."""
    table = [(r.vec_id, r.label, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("label is not null and embedding is not null").collect()]
    trained = [x for x in table if x[0] % 3 == 0]
    near = {i: sorted((float(np.sqrt(((v - w) ** 2).sum())), o, y) for o, y, w in trained if o != i)[:3] for i, _, v in table}
    expected = {i: min(Counter(y for *_, y in n).items(), key=lambda x: (-x[1], x[0]))[0] for i, n in near.items()}
    assert {r.id: r.label for r in registry.QUERIES["classify_knn"](spark, sf).collect()} == expected


def test_every_tracklet_and_leaf(spark, sf):
    """Spectra of every tracklet, and the ancestors of every leaf, by walking up."""
    v = registry.views(spark, sf)
    heads = {r.head for r in v.pieces.groupBy("head").count().collect()}
    assert {r.key for r in registry.QUERIES["intensity_spectrum"](spark, sf).collect()} == heads
    edges = [(r.source_id, r.target_id) for r in v.edges.collect()]
    parent, expected = {t: s for s, t in edges}, set()
    for leaf in {t for _, t in edges} - {s for s, _ in edges}:
        at = leaf
        while at in parent:
            at = parent[at]
            expected.add((leaf, at))
    assert {(r.spot_id, r.ancestor) for r in registry.QUERIES["ancestors_of"](spark, sf).collect()} == expected
