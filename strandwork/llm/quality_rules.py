"""Quality rules: counts per document, and Jensen-Shannon distance of its histograms to its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, words

#: Common words of English, German, French and Spanish (bins of the word histogram, besides "other").
COMMON_WORDS = (
    "the of and to in a is that it for on was with as be by "
    "der die und den von zu das mit sich des auf ist nicht ein eine "
    "le la les et un une du que pour dans par sur est au "
    "el los que en y por con no para se lo una"
).split()
COMMON = list(dict.fromkeys(COMMON_WORDS))
LETTERS = "".join(chr(ord("A") + i) for i in range(len(COMMON)))
#: Bins of the character histogram, of the characters in words.
CLASSES = ("lower", "upper", "digit", "mark", "symbol", "other")
CHAR_BINS, COMMON_BINS = [f"char_{c}" for c in CLASSES], [f"word_{w}" for w in COMMON] + ["word_others"]
#: Least words of a document and of a reference for a verdict; largest distances that are ever kept.
MIN_WORDS, MIN_REFERENCE, MAX_CHARS, MAX_WORDS = 50, 1000, 0.30, 0.60
#: Bands of length in an octave of words; least different documents of a band for limits of its own.
BANDS, MIN_BAND = 2, 30
#: Distances from the median that are kept, in standard deviations as the quartile above (chars) or below (words) tells
#: them, and the least of one, as a share of the median. Junk lies above: words are judged by the side without it, characters,
#: whose clean documents have a long tail (numbers, names), by the other one.
FAR_CHARS, FAR_WORDS, QUARTILE, LEAST_CHARS, LEAST_WORDS = 15.0, 4.5, 0.6745, 0.02, 0.1
#: References up to this many rows are broadcast.
MAX_BROADCAST = 1000
SYMBOLS = "[#*$%&|<>]"


def base_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang and any other columns) as (_row, lang, the base counts, chars, common): one narrow pass over whole texts.

    _row holds the row as it was, so that its columns can't clash with ours; CHAR_BINS count characters by class,
    COMMON_BINS the words of COMMON and the others. Null texts count as empty. Nothing leaves the row, so hot keys and long texts need no care.
    """
    line = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"), F.col("lang").alias("lang"))
    df = docs.select("_row", "lang", words(F.col("text")).alias("w"), line.alias("lines"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns({
        "bare": F.array_join("w", ""),
        "rest": F.regexp_replace("text", r"[\x20\x09-\x0D\p{Ll}]+", ""),
        "n_words": F.size("w").cast("long"),
        # A window is compared by its 64-bit hash: within one text that tells windows apart.
        "windows": F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))),
        # One letter per common word, in one string: what a letter's removal takes away is its count.
        "hits": F.array_join(F.transform(F.filter("w", lambda w: F.lower(w).isin(COMMON)), lambda w: F.substring(F.lit(LETTERS), F.array_position(F.array(*map(F.lit, COMMON)), F.lower(w)).cast("int"), F.lit(1))), ""),
    }).drop("text")
    # Only a text with some window twice has its windows sorted.
    df = df.withColumn("grams", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("g"), i.alias("i"))))))
    df = df.withColumns({
        "word_chars": F.length("bare").cast("long"),
        "no_upper": F.regexp_replace("rest", r"\p{Lu}+", ""),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "again": F.filter("grams", lambda x, k: (F.get("grams", k - 1)["g"] == x["g"]) | (F.get("grams", k + 1)["g"] == x["g"])),
    }).drop("bare", "lines")
    symbols = F.length("no_upper") - F.length(F.regexp_replace("no_upper", SYMBOLS, ""))
    digits = F.length("no_upper") - F.length(F.regexp_replace("no_upper", r"\d+", ""))
    marks = F.length("no_upper") - F.length(F.regexp_replace("no_upper", r"[.,;:!?'\"()-]+", ""))
    counts = [F.length("hits") - F.length(F.replace(F.col("hits"), F.lit(c), F.lit(""))) for c in LETTERS]
    df = df.select(
        "_row", "lang", "n_words", "word_chars", symbols.cast("long").alias("n_symbols"), "n_dup_lines",
        F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("again", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("rest").alias("r"), F.length("no_upper").alias("u"), digits.alias("d"), marks.alias("m"), F.length("hits").alias("n_hits"), *[c.cast("long").alias(x) for c, x in zip(counts, COMMON_BINS)],
    )
    chars = [F.col("word_chars") - F.col("r"), F.col("r") - F.col("u"), F.col("d"), F.col("m"), F.col("n_symbols"), F.col("u") - F.col("d") - F.col("m") - F.col("n_symbols")]
    others = (F.col("n_words") - F.col("n_hits")).alias(COMMON_BINS[-1])
    return df.select("_row", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[c.cast("long").alias(x) for c, x in zip(chars, CHAR_BINS)], *COMMON_BINS[:-1], others)


def references(counts: DataFrame) -> DataFrame:
    """(ref_lang, ref_words, ref_chars, ref_common): histograms summed over all documents of each language; null: over all."""
    # Each bin is a column of its own: as elements of an array, all would be made again for each sum.
    sums = [F.sum(x).alias(x) for x in CHAR_BINS + COMMON_BINS]
    by_lang = cut(counts.groupBy(F.col("lang").alias("ref_lang")).agg(F.sum("n_words").alias("ref_words"), *sums), "quality")
    whole = by_lang.groupBy().agg(*[F.sum(x).alias(x) for x in by_lang.columns[1:]]).select(F.lit(None).cast("string").alias("ref_lang"), *by_lang.columns[1:])
    rows = by_lang.where("ref_lang is not null").unionByName(whole)
    return rows.select("ref_lang", "ref_words", F.array(*CHAR_BINS).alias("ref_chars"), F.array(*COMMON_BINS).alias("ref_common"))


def with_js_distance(df: DataFrame, p: str, q: str, name: str) -> DataFrame:
    """df plus the square root of the Jensen-Shannon divergence (base 2) of two histograms, 6 places; null if either is empty."""
    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    # The totals are columns of their own: within the functions below they would be made again for each bin.
    df = df.withColumns({f"{name}_{x}": F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) for x in (p, q)})
    df = df.withColumn(f"{name}_both", F.zip_with(p, q, lambda a, b: F.struct((a / F.nullif(f"{name}_{p}", F.lit(0.0))).alias("a"), (b / F.nullif(f"{name}_{q}", F.lit(0.0))).alias("b"))))
    terms = F.transform(f"{name}_both", lambda x: half(x["a"], (x["a"] + x["b"]) / 2) + half(x["b"], (x["a"] + x["b"]) / 2))
    distance = F.round(F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2, F.lit(0.0))), 6)
    return df.withColumn(name, distance).drop(f"{name}_{p}", f"{name}_{q}", f"{name}_both")


def band() -> Column:
    return F.floor(F.log2("n_words") * BANDS).cast("int")


def with_distances(counts: DataFrame, refs: DataFrame, *names: str) -> DataFrame:
    """The named columns of counts, the row of refs of the same language, chars_js and words_js."""
    bins = [F.array(*CHAR_BINS).alias("chars"), F.array(*COMMON_BINS).alias("common")]
    counts = counts.select(*names, "lang", "n_words", *bins)
    rows = counts.join(refs, counts.lang.eqNullSafe(refs.ref_lang), "left")
    return with_js_distance(with_js_distance(rows, "chars", "ref_chars", "chars_js"), "common", "ref_common", "words_js")


def limits(distances: DataFrame, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """(limit_lang, limits): by language, a map from each of its bands of length to the largest chars_js and words_js that are kept.

    A limit is the median of all documents of the language and band plus a multiple of their spread, so that the
    sampling noise of short texts and the divergence of long ones are judged apart. Documents alike in length and
    both distances (exact copies) count once. A band with under MIN_BAND documents takes the limits of the next
    shorter band that has them (never stricter for clean texts, whose noise falls with length), else those of the band
    over all languages, else none. Distances are counted to 4 places before quantiles are taken, so they are exact and no group is large.
    """
    d = distances.where((F.col("n_words") >= min_words) & (F.col("ref_words") >= min_reference))
    d = d.select("lang", "n_words", "chars_js", "words_js").distinct().withColumn("band", band())
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.round(x, 4).alias("value")) for x in ("chars_js", "words_js")]))
    n = cut(d.select("lang", "band", each.alias("m")).groupBy("lang", "band", "m.kind", "m.value").agg(F.count("*").alias("n")), "distances")

    def by(*keys: str) -> DataFrame:
        q = n.where("lang is not null") if "lang" not in keys else n
        q = q.groupBy(*keys).agg(*[F.expr(f"percentile(value, array(0.25, 0.5, 0.75), n) filter (where kind = '{x}')").alias(x) for x in ("chars_js", "words_js")], F.expr("sum(n) filter (where kind = 'words_js')").alias("docs"))
        low, mid, high = ([F.col(x)[i] for x in ("chars_js", "words_js")] for i in range(3))
        chars = mid[0] + FAR_CHARS * F.greatest((high[0] - mid[0]) / QUARTILE, LEAST_CHARS * mid[0])
        common = mid[1] + FAR_WORDS * F.greatest((mid[1] - low[1]) / QUARTILE, LEAST_WORDS * mid[1])
        return q.select(*keys, F.when(F.col("docs") >= MIN_BAND, F.struct(chars.alias("chars"), common.alias("words"))).alias("at"))

    shorter = F.last("at", True).over(Window.partitionBy("lang").orderBy("band"))
    whole = by("band").select("band", F.col("at").alias("whole"))
    rows = by("lang", "band").withColumn("at", shorter).join(whole, "band", "left")
    at = F.coalesce("at", F.when(F.col("lang").isNotNull(), F.col("whole")))
    return rows.groupBy(F.col("lang").alias("limit_lang")).agg(F.map_from_entries(F.collect_list(F.struct("band", at.alias("at")))).alias("limits"))


def judge(docs: DataFrame, carry: tuple[str, ...] = (), min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE, max_chars: float = MAX_CHARS, max_words: float = MAX_WORDS) -> DataFrame:
    """One row per row of docs: _row (the row as it was), the base counts, base_failed, chars_js, words_js and kept.

    The references are the histograms of all documents of the same language (of all documents where lang is null).
    The method rejects a document if a distance exceeds that of limits() for its language and length, or max_chars or
    max_words in any case; a document of fewer than min_words words, or a reference of fewer than min_reference
    words, is too short for that verdict, which then stays "keep". Empty tables give empty results; repeated rows
    are judged alike; a null doc_id is as good as any. With carry, _row has only those columns and the counts are
    written to the shared folder, so that texts are read once. Without, the first pass only writes histograms and the
    second makes the counts again beside the whole row, whose text is never written. Each row is joined with its
    reference and limits: by broadcast if there are few languages, else by a shuffle of the rows.
    """
    counts = base_counts(docs)
    if carry:
        counts = narrow = cut(counts.withColumn("_row", F.struct(*[F.col(f"_row.{c}").alias(c) for c in carry])), "counts")
    else:
        narrow = cut(counts.select("lang", "n_words", *CHAR_BINS, *COMMON_BINS), "counts")
    refs = references(narrow)
    few = refs.count() <= MAX_BROADCAST
    most = limits(with_distances(narrow, F.broadcast(refs) if few else refs), min_words, min_reference)
    refs = cut(refs.join(most, refs.ref_lang.eqNullSafe(most.limit_lang), "left").drop("limit_lang"), "limits")
    refs = F.broadcast(refs) if few else refs
    rows = with_distances(counts, refs, "_row", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    most = F.element_at("limits", band())
    over = [F.col(x) > F.least(F.lit(y), F.coalesce(most[z], F.lit(y))) for x, y, z in (("chars_js", max_chars, "chars"), ("words_js", max_words, "words"))]
    far = (F.col("n_words") >= min_words) & (F.col("ref_words") >= min_reference) & (over[0] | over[1])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # One expression over both sides of the join: it stays above it, and the counts are made once.
    kept = ~F.coalesce(failed | far, failed)
    return rows.withColumns({"base_failed": failed, "kept": kept})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    return judge(docs).where("kept").select("_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged, all of them against their language's histograms."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, carry=("doc_id",)).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_js", "words_js", "kept")
