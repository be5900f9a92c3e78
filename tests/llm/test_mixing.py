"""Mixing by itself: a dominant source beside very small ones, empty tables, and the order of the schedule."""

from collections import Counter

from conftest import rows

from strandwork.llm import mixing


def totals(found):
    taken, target = Counter(), {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    return taken, target


def test_small_sources_beside_a_dominant_one(spark):
    big = spark.range(400).selectExpr("id as doc_id", "repeat('w ', 25000) as text", "'m' as source")
    small = spark.range(30).selectExpr("id + 1000 as doc_id", "'a b c d e f g h i j' as text", "concat('s', cast(id as string)) as source")
    taken, target = totals(rows(mixing.mix(big.union(small))))
    assert len(target) == 31 and all(abs(taken[s] - target[s]) <= 0.5 for s in target), (taken, target)
    assert all(target[f"s{i}"] == 20 for i in range(30))


def test_empty_and_wordless(spark, empty_dir):
    assert mixing.op6_mixing(spark, empty_dir).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, " \n", "a"), (None, None, None)], "doc_id long, text string, source string")
    found = rows(mixing.mix(docs))
    assert len(found) == 4 and all(r["size"] == r["taken"] == r["source_size"] == 0 for r in found)
    assert mixing.keep_taken(docs).count() == 0


def test_schedule_is_spread(spark):
    """Any run of slots holds each source about in proportion to its target, and blocks come in the order of their ranks."""
    docs = spark.range(600).selectExpr("id as doc_id", "repeat('w ', 2048) as text", "element_at(array('a', 'b', 'c'), cast(id % 3 as int) + 1) as source")
    goals = mixing.targets(mixing.sized(docs))
    target = {r["source"]: r["target"] for r in rows(goals)}
    plan = rows(mixing.schedule(spark, goals))
    slots = Counter()
    for r in plan:
        slots[r["source"]] += r["times"]
        assert 1 <= r["times"] <= mixing.REPEATS
    for s, t in target.items():
        assert abs(slots[s] - t / mixing.BLOCK) <= 12, (s, slots, target)
        used = sorted((r["block"], r["times"]) for r in plan if r["source"] == s)
        assert [b for b, _ in used] == list(range(len(used))) and [n for _, n in used] == sorted((n for _, n in used), reverse=True)


def test_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda df: sorted((r["doc_id"], r["taken"]) for r in rows(df))
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(7)))


def test_the_result_comes_by_the_schedule(spark, monkeypatch):
    """In the result, any window of slots holds each source within a few blocks of its share; another schedule gives other rows."""
    docs = spark.range(1500).selectExpr("id as doc_id", "repeat('w ', 1024) as text", "element_at(array('a', 'b', 'c'), cast(id % 3 as int) + 1) as source")
    found = rows(mixing.mix(docs))
    _, target = totals(found)
    whole = sum(target.values())
    at = sorted((r["first_slot"], r["source"]) for r in found if r["first_slot"] is not None and r["n_slots"] == 1)
    once = {r["source"] for r in found} - {r["source"] for r in found if r["n_slots"] > 1}
    slots = max(s for s, _ in at) + 1
    for low in range(0, slots - 200, 97):
        here = Counter(s for k, s in at if low <= k < low + 200)
        for s in once:
            assert abs(here[s] - 200 * target[s] / whole) <= 8, (low, s, here)
    assert once and all((r["n_slots"] > 0) == (r["first_slot"] is not None) for r in found)
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda spark, goals: real(spark, goals).limit(0))
    assert {(r["doc_id"], r["first_slot"]) for r in rows(mixing.mix(docs))} != {(r["doc_id"], r["first_slot"]) for r in found}
