"""Lineage: roots, leaves, splits, generations and tracklets of branching tracks.

edges(track_id, source_id, target_id) link spots from frame to frame. Depth is reached by pointer doubling: each
round joins every spot's pointer with the pointer of what it points at, so a lineage of n levels takes log2(n)
joins instead of n. Rounds are written to the shared checkpoint folder, so a lost executor costs no recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share; a temporary folder only where that is unset and driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='strandwork-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/strandwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, whose joins by key go by shuffle: Spark takes a table's size from its compressed files, and would hand ten times that to the driver to broadcast it."""
    return df.hint("merge")


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that saved() has written to the session's shared folder: only when no result that reads it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/strandwork")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source_id").alias("spot_id")).agg(F.sort_array(F.collect_list("target_id")).alias("children"))


def parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target_id").alias("spot_id")).agg(F.sort_array(F.collect_list("source_id")).alias("parents"))


def roots(edges: DataFrame) -> DataFrame:
    """(track_id, spot_id): sources that are nobody's target."""
    return edges.select("track_id", F.col("source_id").alias("spot_id")).distinct().join(edges.select(F.col("target_id").alias("spot_id")), "spot_id", "left_anti").select("track_id", "spot_id")


def leaves(edges: DataFrame) -> DataFrame:
    """(track_id, spot_id): targets that are nobody's source."""
    return edges.select("track_id", F.col("target_id").alias("spot_id")).distinct().join(edges.select(F.col("source_id").alias("spot_id")), "spot_id", "left_anti").select("track_id", "spot_id")


def splits(edges: DataFrame) -> DataFrame:
    """(track_id, spot_id): sources with more than one target."""
    return edges.groupBy("track_id", F.col("source_id").alias("spot_id")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def splits_with_detections(edges: DataFrame, detected: DataFrame) -> DataFrame:
    """Splits and, if more than one detection (spot_id) was matched, detected sources that are neither splits nor leaves."""
    enough = detected.agg(F.count("*").alias("_n")).where("_n > 1")
    sources = edges.select("track_id", F.col("source_id").alias("spot_id")).distinct()
    more = sources.join(detected.select("spot_id").distinct(), "spot_id", "left_semi").join(splits(edges).select("spot_id"), "spot_id", "left_anti")
    return splits(edges).unionByName(more.join(F.broadcast(enough), F.lit(True)).select("track_id", "spot_id"))


def merges(edges: DataFrame) -> DataFrame:
    """(track_id, spot_id): targets with more than one source."""
    return edges.groupBy("track_id", F.col("target_id").alias("spot_id")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def gaps(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """Edges that span more than one frame, with the number of frames."""
    at = spots.select("spot_id", "frame")
    spanned = edges.join(at.withColumnsRenamed({"spot_id": "source_id", "frame": "_a"}), "source_id").join(at.withColumnsRenamed({"spot_id": "target_id", "frame": "_b"}), "target_id")
    return spanned.withColumn("frames", F.col("_b") - F.col("_a")).where("frames > 1").select("track_id", "source_id", "target_id", "frames")


def division_label(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(track_id, dividing, number_dividing) of every track."""
    counts = splits(edges).groupBy("track_id").agg(F.count("*").alias("number_dividing"))
    labelled = spots.select("track_id").distinct().join(counts, "track_id", "left").withColumn("number_dividing", F.coalesce("number_dividing", F.lit(0)))
    return labelled.withColumn("dividing", F.col("number_dividing") > 0)


def splits_by_time(spots: DataFrame, edges: DataFrame) -> DataFrame:
    return splits(edges).join(spots.select("spot_id", "frame"), "spot_id").orderBy("frame", "spot_id")


def one_parent(edges: DataFrame) -> DataFrame:
    """(spot_id, parent): of several parents (a merge) the one with the smallest id."""
    return edges.groupBy(F.col("target_id").alias("spot_id")).agg(F.min("source_id").alias("parent"))


def branches(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(spot_id, generation, head) by one pointer doubling: splits strictly above each spot, and the root or child of a split that begins its piece.

    A row's pointer is the spot 2^k steps above it; generation and head tell what lies on the way there. Each round joins
    the rows that have not reached their root with what their pointers know; finished rows are only looked up.
    """
    split = splits(edges).select(F.col("spot_id").alias("parent"), F.lit(1).alias("_split"))
    start = spots.select("spot_id").join(one_parent(edges), "spot_id", "left").join(split, "parent", "left")
    begins = F.col("parent").isNull() | F.col("_split").isNotNull()
    start = start.select("spot_id", F.col("parent").alias("ptr"), F.coalesce("_split", F.lit(0)).cast("long").alias("generation"), F.when(begins, F.col("spot_id")).alias("head"))
    state = saved(start, "branches")
    done, going = [state.where("ptr is null")], state.where("ptr is not null")
    while not going.isEmpty():
        known = going
        for d in done:
            known = known.unionByName(d)
        ahead = known.select(F.col("spot_id").alias("_k"), F.col("ptr").alias("_p"), F.col("generation").alias("_g"), F.col("head").alias("_h"))
        joined = going.join(by_shuffle(ahead), F.col("ptr") == F.col("_k"))
        state = saved(joined.select("spot_id", F.col("_p").alias("ptr"), (F.col("generation") + F.col("_g")).alias("generation"), F.coalesce("head", "_h").alias("head")), "branches")
        done.append(state.where("ptr is null"))
        going = state.where("ptr is not null")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("spot_id", "generation", "head")


def generations(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(spot_id, track_id, generation): number of split spots strictly above each spot."""
    return branches(spots, edges).select("spot_id", "generation").join(spots.select("spot_id", "track_id"), "spot_id")


def tracklet_heads(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(spot_id, head): the root or child of a split that begins each spot's unbranched piece."""
    return branches(spots, edges).select("spot_id", "head")


def tracklets(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(spot_id, track_id, generation, head, tracklet_no): pieces numbered from 0 by (generation, frame, head) within their track."""
    known = by_shuffle(saved(by_shuffle(branches(spots, edges)).join(spots.select("spot_id", "track_id"), "spot_id"), "known"))
    heads = known.where("spot_id = head").join(spots.select("spot_id", "frame"), "spot_id").select("head", "track_id", "generation", "frame")
    numbered = heads.withColumn("tracklet_no", (F.row_number().over(Window.partitionBy("track_id").orderBy("generation", "frame", "head")) - 1).cast("long"))
    return known.join(numbered.select("head", "tracklet_no"), "head").select("spot_id", "track_id", "generation", "head", "tracklet_no")


def tracklet_graph(pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """(track_id, tracklet_no, parent_no): daughter tracklet to parent tracklet."""
    a = pieces.select(F.col("spot_id").alias("source_id"), F.col("tracklet_no").alias("parent_no"))
    b = pieces.select(F.col("spot_id").alias("target_id"), "tracklet_no")
    return edges.join(a, "source_id").join(b, "target_id").where("parent_no <> tracklet_no").select("track_id", "tracklet_no", "parent_no").distinct()


def tracklet_spans(pieces: DataFrame, spots: DataFrame) -> DataFrame:
    """(track_id, tracklet_no, generation, start_frame, end_frame, spots) of each tracklet."""
    return pieces.join(spots.select("spot_id", "frame"), "spot_id").groupBy("track_id", "tracklet_no").agg(F.min("generation").alias("generation"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("spots"))


def tracklet_life(spans: DataFrame) -> DataFrame:
    """Life of each tracklet, end - start; first tracklets only if it is above 0."""
    return spans.withColumn("life", F.col("end_frame") - F.col("start_frame")).where("generation > 0 or life > 0")


def propagate_fate(spots: DataFrame, fates: DataFrame) -> DataFrame:
    """(spot_id, fate): a label (spot_id, fate) of one spot goes to every spot of its track, the largest of several; -1 elsewhere."""
    by_track = fates.join(spots.select("spot_id", "track_id"), "spot_id").groupBy("track_id").agg(F.max("fate").alias("fate"))
    return spots.select("spot_id", "track_id").join(by_track, "track_id", "left").select("spot_id", F.coalesce("fate", F.lit(-1)).alias("fate"))


def reached(hops: DataFrame, asked: DataFrame) -> DataFrame:
    """(spot_id, other) of all that the asked spots reach over hops (spot_id, other).

    A round knows the pairs of under 2^k steps and the hops of just 2^k steps; the one grow by the other, and the other double.
    In a forest nothing has more than one ancestor 2^k steps above it, so hops never outnumber the spots.
    """
    far = saved(hops.distinct(), "hops")
    starts = asked.select("spot_id").distinct()
    found = saved(starts.join(far, "spot_id"), "reached")
    while True:
        # twice as many steps at once, from what has been found so far and from the asked spots themselves
        step = far.select(F.col("spot_id").alias("_m"), F.col("other").alias("_a"))
        far = saved(far.join(step, F.col("other") == F.col("_m")).select("spot_id", F.col("_a").alias("other")).distinct(), "hops")
        step = far.select(F.col("spot_id").alias("_m"), F.col("other").alias("_a"))
        more = found.join(step, F.col("other") == F.col("_m")).select("spot_id", F.col("_a").alias("other"))
        grown = saved(found.unionByName(more).unionByName(starts.join(far, "spot_id")).distinct(), "reached")
        if grown.count() == found.count():
            return found
        found = grown


def ancestors_of(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(spot_id, ancestor) of the asked spots: one track's depth at most for each; of several parents the smallest counts."""
    return reached(one_parent(edges).select("spot_id", F.col("parent").alias("other")), asked).withColumnRenamed("other", "ancestor")


def descendants_of(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(spot_id, descendant) of the asked spots: all that follow them in their track."""
    return reached(edges.select(F.col("source_id").alias("spot_id"), F.col("target_id").alias("other")).distinct(), asked).withColumnRenamed("other", "descendant")


def intervals(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(spot_id, root, enter, leave): places of each spot in a walk around its tree, children by id; a spot descends from another if its interval lies in the other's.

    The walk enters a spot, goes through its children and leaves it. What follows each step is known from parent and
    siblings alone; how many steps are left to the end is found by doubling, log2 of the longest walk rounds, each
    written. Of several parents (a merge) the smallest counts. A tree of n spots has places 0 .. 2 n - 1, so (leave - enter - 1) / 2 spots descend from one.
    """
    up = spots.select("spot_id").distinct().join(one_parent(edges), "spot_id", "left")
    next_ = F.lead("spot_id").over(Window.partitionBy("parent").orderBy("spot_id"))
    linked = up.where("parent is not null").withColumn("next", next_).unionByName(up.where("parent is null").withColumn("next", F.lit(None).cast(dict(up.dtypes)["spot_id"])))
    first = up.where("parent is not null").groupBy(F.col("parent").alias("spot_id")).agg(F.min("spot_id").alias("child"))
    each = linked.join(first, "spot_id", "left")
    step = lambda spot, out: F.struct(F.col(spot).alias("s"), F.lit(out).alias("out"))
    entered = each.select(step("spot_id", 0).alias("at"), F.when(F.col("child").isNotNull(), step("child", 0)).otherwise(step("spot_id", 1)).alias("to"))
    left = each.select(step("spot_id", 1).alias("at"), F.when(F.col("next").isNotNull(), step("next", 0)).when(F.col("parent").isNotNull(), step("parent", 1)).alias("to"))
    both = entered.unionByName(left)
    # A root's last step has none after it: it ends the walk, and names the tree.
    state = saved(both.select("at", "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("left"), F.when(F.col("to").isNull(), F.col("at.s")).alias("root")), "walk")
    done, going = [state.where("to is null")], state.where("to is not null")
    while not going.isEmpty():
        known = going
        for d in done:
            known = known.unionByName(d)
        ahead = known.select(F.col("at").alias("_a"), F.col("to").alias("_t"), F.col("left").alias("_l"), F.col("root").alias("_r"))
        state = saved(going.join(ahead, F.col("to") == F.col("_a")).select("at", F.col("_t").alias("to"), (F.col("left") + F.col("_l")).alias("left"), F.coalesce("root", "_r").alias("root")), "walk")
        done.append(state.where("to is null"))
        going = state.where("to is not null")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    flat = out.groupBy(F.col("at.s").alias("spot_id"), "root").agg(F.max(F.when(F.col("at.out") == 0, F.col("left"))).alias("_in"), F.max(F.when(F.col("at.out") == 1, F.col("left"))).alias("_out"))
    longest = flat.where("spot_id = root").select(F.col("root").alias("_root"), F.col("_in").alias("_all"))
    return flat.join(longest, F.col("root") == F.col("_root")).select("spot_id", "root", (F.col("_all") - F.col("_in")).alias("enter"), (F.col("_all") - F.col("_out")).alias("leave"))


def descendant_counts(places: DataFrame) -> DataFrame:
    """(spot_id, descendants) from intervals(): no pair of spots is made."""
    return places.select("spot_id", F.expr("(leave - enter - 1) div 2").alias("descendants"))


def related(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs (a, b) plus `descends`: whether b descends from a (a spot from itself: no), by two look-ups of intervals."""
    side = lambda x: places.select(F.col("spot_id").alias(x), *[F.col(c).alias(f"_{x}_{c}") for c in ("root", "enter", "leave")])
    inside = (F.col("_a_root") == F.col("_b_root")) & (F.col("_a_enter") < F.col("_b_enter")) & (F.col("_b_leave") < F.col("_a_leave"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("descends", F.coalesce(inside, F.lit(False))).select(*pairs.columns, "descends")


def attach_tracklet_dim(spots: DataFrame, pieces: DataFrame) -> DataFrame:
    """(spot_id, track_id, generation, tracklet_no, life): spots with their tracklet and how many frames it lasts."""
    life = tracklet_spans(pieces, spots).select("track_id", "tracklet_no", "generation", (F.col("end_frame") - F.col("start_frame")).alias("life"))
    mine = pieces.select("spot_id", "track_id", "tracklet_no")
    return spots.select("spot_id").join(mine, "spot_id").join(life, ["track_id", "tracklet_no"]).select("spot_id", "track_id", "generation", "tracklet_no", "life")


def keep_filtered(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of the listed tracks."""
    return rows.join(listed.select("track_id").distinct(), "track_id", "left_semi")
