"""Mixing sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, words

#: Weights of the sources in code-point order, repeating; share of all tokens that the mix has; most times that a token is used.
WEIGHTS, SHARE, REPEATS = (5.0, 2.0, 1.0), 1.5, 2
#: Words of a block, at any size of the corpus; what a source's blocks lack or have over its target is set right by words.
BLOCK = 1024
#: Slots whose ranks are counted together; bits of the cells by which slots find their source.
CHUNK, CELL_BITS = 1 << 16, 12
#: Sources up to this many are broadcast.
MAX_BROADCAST = 10_000
#: Hexadecimal digits of the shuffle key that a source's documents are first dealt by.
DIGITS = 3


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, key): the number of words (null text: 0), and the shuffle key, md5 of the id as text."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("key"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): the mix's tokens by weight, each at most REPEATS times the source's size.

    What is over is shared anew by weight among the others until none is above: so each target is
    min(REPEATS * size, level * weight) for one level. With the sources ordered by REPEATS * size / weight, the
    level is set by the first whose cap is not reached (later ones would give lower levels). One row per source; sources are few against documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), place % len(WEIGHTS))
    s = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(REPEATS))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("cap")
    s = s.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(after), "all": F.sum("source_size").over(whole)})
    s = s.withColumn("level", (SHARE * F.col("all") - F.col("capped")) / F.col("open"))
    s = s.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    s = s.withColumn("level", F.max("fits").over(whole))
    return s.select("source", "source_size", F.round(F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")), 6).alias("target"))


def schedule(spark: SparkSession, goals: DataFrame) -> DataFrame:
    """(source, block, times, first): how often each of a source's equal-token blocks is in the mix, and the first slot that it has there.

    Slot k's van der Corput point (k's bits reversed, as a fraction) falls into one source's part of the
    cumulative targets. A source's slots are ranked in order, rank r takes its block r modulo its blocks, and
    ranks beyond REPEATS passes are empty. There is a slot per BLOCK words of the mix, so they grow with it. A
    point finds its source by an equi-join of cells, of which each source's part covers a run (2^CELL_BITS and one
    per source in all), and ranks are counted by chunks of slots, so that a source with most of the slots is many
    tasks' work.
    """
    mix = goals.agg(F.coalesce(F.ceil(F.sum("target")), F.lit(0)).cast("long").alias("mix")).first().mix or 0
    count = -(-mix // BLOCK)
    bits = max(CELL_BITS, (count - 1).bit_length())
    order = Window.orderBy(F.col("source").asc_nulls_last())
    parts = goals.where("target > 0").withColumn("high", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low = (F.col("high") - F.col("target")) / F.lit(float(max(mix, 1)))
    parts = parts.select("source", F.ceil(F.col("source_size") / BLOCK).cast("long").alias("blocks"), F.ceil(low * float(1 << bits)).cast("long").alias("low"))
    parts = parts.withColumns({"part": F.row_number().over(order), "high": F.coalesce(F.lead("low").over(order), F.lit(1 << bits).cast("long"))}).where("high > low")
    cell = lambda place: F.shiftright(place, bits - CELL_BITS)
    parts = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    place = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long")
    slots = spark.range(count).select(F.col("id").alias("slot"), place.alias("place")).withColumn("cell", cell(F.col("place")))
    slots = slots.join(parts, "cell").where("place >= low and place < high").select("part", "source", "blocks", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    chunks = slots.groupBy("part", "chunk").agg(F.count("slot").alias("n"))
    before = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("part", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = slots.withColumn("in_chunk", F.row_number().over(Window.partitionBy("part", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(chunks, ["part", "chunk"]).withColumn("rank", F.col("before") + F.col("in_chunk"))
    taken = ranked.where(F.col("rank") < F.col("blocks") * REPEATS)
    return taken.groupBy("source", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("slot").alias("times"), F.min("slot").alias("first"))


def remainders(goals: DataFrame, plan: DataFrame) -> DataFrame:
    """goals plus low, high and sign: a source takes its stream's words in order, pass after pass; those from low to high are yet to be taken (1) or taken too much (-1)."""
    slots = plan.groupBy(F.col("source").alias("slot_source")).agg(F.sum("times").alias("n"))
    n, blocks = F.coalesce("n", F.lit(0)), F.greatest(F.ceil(F.col("source_size") / BLOCK), F.lit(1)).cast("long")
    done = F.floor(n / blocks) * F.col("source_size") + F.least((n % blocks) * BLOCK, "source_size")
    rows = goals.join(slots, goals.source.eqNullSafe(slots.slot_source), "left").withColumns({"done": done.cast("long"), "goal": F.least(F.round("target").cast("long"), F.col("source_size") * REPEATS)})
    return rows.select(*goals.columns, F.least("done", "goal").alias("low"), F.greatest("done", "goal").alias("high"), F.signum(F.col("goal") - F.col("done")).cast("long").alias("sign"))


def streamed(sizes: DataFrame) -> DataFrame:
    """sizes plus `start`: each document's place in its source's stream of tokens, in order of (key, doc_id, size).

    Sums by (source, first digits of the key), then within them: a source with a third of all rows is dealt to
    16^DIGITS tasks' groups. Rows that are alike in all of these columns are interchangeable.
    """
    dealt = sizes.withColumn("deal", F.substring("key", 1, DIGITS))
    sums = dealt.groupBy("source", "deal").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("deal").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "deal").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return dealt.join(sums, dealt.source.eqNullSafe(sums.s) & (dealt.deal == sums.d)).withColumn("start", F.col("before") + F.col("within")).drop("deal", "s", "d", "before", "within", "key")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target (the source's), taken: the document's words in the mix, repeats counted; first_slot and n_slots.

    The mix is its slots in order: first_slot is the first one that has words of the document (null: none has; what a top-up
    alone takes comes after all slots), n_slots how many have. By first_slot, documents of all sources lie as the schedule spreads them.

    A null source is a source of its own, the last. Null, empty and wordless texts have size 0 and take nothing.
    A block's words are consecutive words of its source's shuffled documents, so a document can be taken in part.
    After the schedule each source is topped up or trimmed at the end of its last pass, so that it takes its target
    to the word at any size. Reruns agree: the shuffle is a hash of the id. Texts are read once and only sizes are written and shuffled.
    """
    sizes = cut(sized(docs, doc_id, text, source), "sizes")
    goals = cut(targets(sizes), "targets")
    plan = cut(schedule(docs.sparkSession, goals), "plan")
    rows = cut(streamed(sizes).withColumn("row", F.monotonically_increasing_id()), "stream")
    reach = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))
    pieces = rows.where("size > 0").select("row", "source", "start", "size", F.explode(reach).alias("block"))
    pieces = pieces.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("start", F.col("block") * BLOCK))
    whole_plan = plan
    plan = plan.select(F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), "times", "first")
    used = pieces.join(plan, pieces.source.eqNullSafe(plan.plan_source) & (pieces.block == plan.plan_block)).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("first").alias("first_slot"), F.sum("times").alias("n_slots"))
    goals = cut(remainders(goals, whole_plan), "remainders").withColumnRenamed("source", "goal_source").withColumnRenamed("source_size", "total")
    goals = F.broadcast(goals) if goals.count() <= MAX_BROADCAST else goals
    out = rows.join(used, "row", "left").join(goals, rows.source.eqNullSafe(goals.goal_source))
    passes = [F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("high") - F.col("total") * k) - F.greatest("start", F.col("low") - F.col("total") * k)) for k in range(REPEATS)]
    taken = F.coalesce("taken", F.lit(0)) + F.col("sign") * sum(passes, F.lit(0))
    return out.select("doc_id", "size", "source", F.col("total").alias("source_size"), "target", taken.cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))


def keep_taken(docs: DataFrame) -> DataFrame:
    """The documents of which the mix takes words, each as often as it takes the most of its words (1 to REPEATS times), with all their columns.

    A document that the mix takes in part stays whole. Documents are known by doc_id; rows that share one are taken
    as often as the most taken of them.
    """
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    plan = mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias("mix_id")).agg(F.max(times).alias("times"))
    both = docs.join(plan, docs.doc_id.eqNullSafe(plan.mix_id))
    return both.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[docs[c] for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
