"""The pipeline's stages, each on its own input, and the whole."""

from collections import Counter

import corpus_pipeline as C
from conftest import rows
from test_line_dedup import brute as lines_brute
from test_near_dedup import brute as near_brute

from strandwork.llm import mixing, quality_rules
from strandwork.llm.common import cut


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in C.STAGES[:-1]:
        steps.append(cut(stage(spark, steps[-1], sf), "test"))
        assert steps[-1].columns == columns, name
    quality, lined, near, mixed = steps[1:]
    good = {r["doc_id"] for r in rows(quality_rules.op2_quality_rules(spark, sf)) if r["kept"]}
    assert {r.doc_id for r in quality.collect()} == good
    left = {i: t for i, t, _ in lines_brute([(r.doc_id, r.text) for r in quality.collect()]) if t.strip()}
    assert {r.doc_id: r.text for r in lined.collect()} == left
    groups = near_brute([(r.doc_id, r.text) for r in lined.collect()], 80, 5)
    assert {r.doc_id for r in near.collect()} == {g["doc_id"] for g in groups if g["kept"]}
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in rows(mixing.mix(near)) if r["taken"]}
    assert Counter(r.doc_id for r in mixed.collect()) == taken
    coded = rows(C.STAGES[-1][1](spark, mixed, sf))
    assert Counter(r["doc_id"] for r in coded) == taken and all(r["n_pieces"] > 0 for r in coded)


def test_odd_and_empty(spark, odd_dir, empty_dir):
    assert C.run(spark, odd_dir).count() >= 0
    assert C.run(spark, empty_dir).count() == 0


def test_mixing(spark, sf, odd_dir):
    """Sizes, targets by rounds of sharing, and what is taken against the targets."""
    for path in (sf, odd_dir):
        docs = spark.read.parquet(f"{path}/documents.parquet").collect()
        found = rows(mixing.mix(spark.read.parquet(f"{path}/documents.parquet")))
        import re
        sizes = Counter()
        for d in docs:
            sizes[d.source] += len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        mix, goal = 1.5 * sum(sizes.values()), {}
        while True:
            free = [s for s in order if s not in goal]
            rest = mix - sum(goal.values())
            share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 2 * sizes[s]]
            if not over:
                goal |= share
                break
            goal |= {s: 2.0 * sizes[s] for s in over}
        taken = Counter()
        for r in found:
            assert abs(r["target"] - goal[r["source"]]) < 1e-3 and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert len(found) == len(docs)
        for s in order:
            assert abs(taken[s] - goal[s]) <= max(3, 0.01 * mix / len(order)), (s, taken[s], goal[s])


def by_source(found):
    taken, target = Counter(), {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    return taken, target


def test_mixing_small_sources(spark):
    """Sources of a few words beside a source whose blocks are larger than they are take their targets, and so does the large one."""
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', 10000) as text", "'a' as source")
    docs = docs.union(spark.createDataFrame([(1000, "one two three four five", None), (1001, "six seven eight", None), (1002, "a b c", "s"), (1003, "", "t")], "doc_id long, text string, source string"))
    taken, target = by_source(rows(mixing.mix(docs)))
    assert target[None] == 16 and target["s"] == 6
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target), (taken, target)
    assert {r.doc_id for r in mixing.keep_taken(docs).where("doc_id >= 1000").collect()} == {1000, 1001, 1002}


def test_mixing_many_sources(spark):
    docs = spark.range(10_050).selectExpr("id as doc_id", "'x y z' as text", "cast(id as string) as source")
    taken, target = by_source(rows(mixing.mix(docs)))
    assert len(target) == 10_050 and all(abs(taken[s] - target[s]) <= 0.5 for s in target)
