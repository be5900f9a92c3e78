"""Line dedup: a suffix array over line sequences by distributed prefix doubling; later copies of repeated runs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Least words of a repeated run of lines.
MIN_WORDS = 20


def dense_ranks(keys: DataFrame, columns: list[str], rank: str) -> DataFrame:
    """Distinct rows of keys with their rank (long, from 0) in order: range partitions, numbered within, offset by the sizes before."""
    ranged = keys.select(*columns).distinct().repartitionByRange(*columns).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "ranks")
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*columns)) - 1
    return ranged.join(F.broadcast(offsets), "_part").select(*columns, (F.col("_before") + within).alias(rank))


def line_table(docs: DataFrame) -> DataFrame:
    """(row, doc_id, lines): lines is an array of (no, h, n) of the lines with a word: number, 128-bit hash of the line, words."""
    def hashed(x: Column, no: Column) -> Column:
        return F.struct(no.alias("no"), F.unhex(F.md5(x.cast("binary"))).alias("h"), F.size(F.filter(F.split(x, SPACE), lambda w: w != "")).alias("n"))

    lines = F.filter(F.transform(F.split("text", "\n", -1), hashed), lambda x: x["n"] > 0)
    return docs.withColumn("lines", lines)


def repeated(lines: DataFrame, min_words: int) -> DataFrame:
    """(row, no): numbers of the lines to delete, of written lines (row, doc_id, lines).

    1. Lines that occur once in all texts end every repeated run, so only segments of consecutive repeated lines
       with min_words words or more are kept. Of equal segments, which repeat whole, the first stays in; the later ones go.
    2. Prefix doubling over the lines of the segments that are left: rank 0 orders the lines; rank k + 1 orders
       (rank k, rank k 2^k lines further on), which is the order of the suffixes by 2^(k+1) lines. It ends where it
       orders them by the longest run that is asked for; a line has a word, so that is min_words lines at most.
    3. In that order the longest common prefix of each suffix with the one before it, and its intervals: a run of m lines
       is one where no such prefix is under m. For each line the shortest run of min_words words that starts there,
       and the one that ends there, are looked up; members of an interval other than its first are copies. Any longer
       repeated run is the union of such runs, so these cover the maximal ones.
    """
    flat = lines.select("row", "doc_id", F.posexplode("lines").alias("i", "x")).select("row", "doc_id", "i", F.xxhash64("x.h").alias("key"), "x")
    many = cut(flat.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "many")
    hits = flat.select("row", "i", "key").join(many, "key", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("i")).alias("at"))
    # Segments: runs of consecutive repeated lines of one text.
    marked = lines.join(hits, "row").withColumn("at", F.filter("at", lambda i: i.isNotNull()))
    starts = F.filter("at", lambda i, k: (k == 0) | (F.get("at", k - 1) != i - 1))
    ends = F.filter("at", lambda i, k: (k == F.size("at") - 1) | (F.get("at", k + 1) != i + 1))
    runs = marked.withColumn("run", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))))
    runs = runs.withColumn("seg", F.slice("lines", F.col("run.a") + 1, F.col("run.b") - F.col("run.a") + 1))
    total = F.aggregate("seg", F.lit(0), lambda s, x: s + x["n"])
    runs = runs.select("row", "doc_id", F.col("run.a").alias("a"), "seg", total.alias("n"), F.unhex(F.md5(F.array_join(F.transform("seg", lambda x: F.hex(x["h"])), "").cast("binary"))).alias("name"))
    runs = cut(runs, "runs").where(F.col("n") >= min_words)
    # Firsts are written before they are joined: both sides are then plain exchanges, and adaptive execution splits a name of very many copies.
    first = cut(runs.groupBy("name").agg(F.min(F.struct("doc_id", "row", "a")).alias("first")), "firsts")
    runs = cut(runs.join(first, "name").withColumn("is_first", F.struct("doc_id", "row", "a") == F.col("first")), "segments")
    copies = runs.where("not is_first").select("row", F.explode("seg.no").alias("no"))

    left = runs.where("is_first").select(F.monotonically_increasing_id().alias("s"), "doc_id", "row", "seg")
    left = cut(left, "suffixes")
    one = left.select("s", "doc_id", "row", F.posexplode("seg").alias("i", "x")).select("s", "doc_id", "row", "i", "x.no", "x.h", "x.n")
    ranked = cut(one.join(dense_ranks(one, ["h"], "r0"), "h").drop("h"), "r0")
    # The shortest run of min_words words that starts (ends) at each line: its number of lines, by running sums of words.
    w = Window.partitionBy("s").orderBy("i")
    # Every line has a word, so such a run has min_words lines at most: both are found in a frame of so many rows.
    sums = ranked.withColumn("to", F.sum("n").over(w)).withColumn("from", F.col("to") - F.col("n"))
    sums = sums.withColumns({"next": F.collect_list("to").over(w.rowsBetween(0, min_words - 1)), "prior": F.collect_list("to").over(w.rowsBetween(1 - min_words, -1))})
    ahead = F.size(F.filter("next", lambda t: t < F.col("from") + min_words)) + 1
    behind = F.size(F.filter("prior", lambda t: t > F.col("to") - min_words)) + 1
    sums = sums.withColumns({"ahead": F.when(F.array_max("next") >= F.col("from") + min_words, ahead), "behind": F.when(F.col("to") >= min_words, behind)})
    sums = sums.withColumn("prefix", F.collect_list("r0").over(w.rowsBetween(0, min_words - 1)))
    ranked = cut(sums.drop("next", "prior", "from", "to", "n"), "reach")
    longest = ranked.agg(F.greatest(F.max("ahead"), F.max("behind")).alias("m")).first().m or 0
    if not longest:  # no segment is left
        return copies.distinct()
    k = 0
    while 2**k < longest:
        pairs = cut(ranked.withColumn("far", F.coalesce(F.lead(f"r{k}", 2**k).over(w), F.lit(-1))), f"pairs{k}")
        names = dense_ranks(pairs, [f"r{k}", "far"], f"r{k + 1}")
        ranked = cut(pairs.join(names, [f"r{k}", "far"]).drop("far", f"r{k}"), f"r{k + 1}")
        k += 1
    suffixes = intervals(ranked.withColumnRenamed(f"r{k}", "rank"), longest)
    # Runs by their first line and length; each is named by its length and the interval that its suffix is in.
    spans = ranked.select("s", F.explode(F.array(F.struct(F.col("i").alias("at"), F.col("ahead").alias("m")), F.struct((F.col("i") - F.col("behind") + 1).alias("at"), F.col("behind").alias("m")))).alias("run"))
    spans = spans.where("run.m is not null").select("s", "run.at", "run.m").distinct()
    named = spans.join(suffixes.withColumnRenamed("i", "at"), ["s", "at"]).select("s", "at", "m", F.struct("doc_id", "row", "no").alias("place"), F.get("intervals", F.col("m") - 1).alias("interval"))
    named = cut(named, "intervals")
    firsts = cut(named.groupBy("m", "interval").agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "interval-firsts")
    later = named.join(firsts, ["m", "interval"]).where("place <> first").select("s", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("m") - 1)).alias("i")).distinct()
    runs_gone = later.join(suffixes.select("s", "i", "row", "no"), ["s", "i"]).select("row", "no")
    return copies.union(runs_gone).distinct()


def intervals(suffixes: DataFrame, longest: int) -> DataFrame:
    """suffixes (s, i, doc_id, row, no, rank, prefix: ranks of the next lines) plus `intervals`: at m - 1 the number of the interval of common prefix m or more that the suffix is in.

    The suffixes are sorted by range partitions (equal ranks are spread over them); each is compared with the one before
    it, the first of a partition with the last of the partition before. An interval's number is the count of the common
    prefixes under m so far: within the partition, and in those before it, of which there is one row each.
    """
    dealt = cut(suffixes.select("s", "i", "doc_id", "row", "no", "rank", "prefix").repartitionByRange("rank", "s", "i").withColumn("_part", F.spark_partition_id()), "suffix-array")
    order = Window.partitionBy("_part").orderBy("rank", "s", "i")
    ends = dealt.groupBy("_part").agg(F.max_by("prefix", F.struct("rank", "s", "i")).alias("_end"))
    ends = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_end"))
    prior = F.when(F.row_number().over(order) == 1, F.col("_end")).otherwise(F.lag("prefix").over(order))
    equal = F.zip_with("prefix", "_prior", lambda a, b: a.eqNullSafe(b))
    common = F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.when(F.col("_prior").isNotNull(), F.size("prefix")), F.lit(0))
    compared = cut(dealt.join(F.broadcast(ends), "_part").withColumn("_prior", prior).withColumn("lcp", common.cast("int")).drop("_end", "_prior", "prefix"), "common-prefixes")
    under = [F.when(F.col("lcp") < m, 1).otherwise(0) for m in range(1, longest + 1)]
    sums = compared.groupBy("_part").agg(*[F.sum(x).alias(f"_b{m}") for m, x in enumerate(under)])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *[F.coalesce(F.sum(f"_b{m}").over(before), F.lit(0)).alias(f"_b{m}") for m in range(longest)])
    counts = [F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)) for x in under]
    counted = compared.join(F.broadcast(sums), "_part").withColumns({f"_c{m}": c for m, c in enumerate(counts)})
    numbers = [F.col(f"_b{m}") + F.col(f"_c{m}") for m in range(longest)]
    return cut(counted.select("s", "i", "doc_id", "row", "no", F.array(*numbers).alias("intervals")), "suffix-intervals")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text and any other columns) with the text that is left, as (_row, text, n_lines, n_removed).

    A line is what stands between \\n; lines without a word are never compared and always stay. A run of lines of
    one text with min_words words or more that stands earlier (by doc_id, nulls first, then line) too is deleted;
    its first copy stays. Null texts stay null; repeated rows are copies of each other. Only hashes are shuffled,
    except for the last join, which brings the numbers of the deleted lines to their texts.
    """
    # A row's key is a hash of its id and text; rows alike in both are numbered. Texts are shuffled once, by that key, and never written.
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary")))
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"), F.xxhash64(*docs.columns).alias("order"))
    number = F.row_number().over(Window.partitionBy("key").orderBy("order"))
    row = F.concat("key", F.unhex(F.lpad(F.hex("copy"), 8, "0")))
    lines = line_table(keyed.select("doc_id", "key", "order", "text")).select("doc_id", "key", "order", "lines")
    lines = cut(lines.withColumn("copy", number).select(row.alias("row"), "doc_id", "lines"), "lines")
    gone = repeated(lines, min_words).groupBy("row").agg(F.sort_array(F.collect_list("no")).alias("no"))
    gone = gone.select(F.substring("row", 1, 16).alias("key"), F.struct(F.conv(F.hex(F.substring("row", 17, 4)), 16, 10).cast("int").alias("copy"), "no").alias("x"))
    gone = gone.groupBy("key").agg(F.collect_list("x").alias("copies"))
    out = keyed.select("_row", "key", "order").withColumn("copy", number).join(gone, "key", "left")
    mine = F.get(F.filter("copies", lambda x: x["copy"] == F.col("copy")), 0)["no"]
    out = out.withColumn("gone", F.coalesce(mine, F.array().cast("array<int>"))).withColumns({"text": F.col("_row.text"), "parts": F.split("_row.text", "\n", -1)})
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    out = out.withColumn("left", F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")))
    return out.select("_row", F.col("left").alias("text"), F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))


def keep_rest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their texts deduplicated and n_chars (if there is one) counted anew; a text of which no word is left goes."""
    names = docs.columns
    rows = dedup_lines(docs, min_words).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[(made[c] if c in made else F.col("_row")[c]).alias(c) for c in names])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("_row.doc_id", "text", "n_lines", "n_removed")
