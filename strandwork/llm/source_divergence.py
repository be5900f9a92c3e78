"""Source divergence audit: how far each source's words are from those of the other sources of its language, in exact whole numbers."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from .common import ascii_lower, cut

#: What lies between terms: ASCII other than letters. Where languages share a vocabulary, a term's stands before it, with this character between, which no term has.
BETWEEN, MARK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "\0"
#: Languages that have a vocabulary of their own, those with the most documents; each reads the texts twice.
OWN = 24
#: Documents of its language that a kept term is in; terms that rank in the report of a group.
MIN_DOCS, TOP = 10, 10
#: Kept terms that one vocabulary holds on the driver and in each executor (some 100 bytes each); more go to further vocabularies.
MAX_TERMS = 1 << 22
SCALE = 1_000_000_000


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (n + 2 v)), exactly: counts may have 18 digits."""
    whole = "CAST({} AS DECIMAL(19, 0))".format
    return F.expr(f"1 + ({whole(SCALE)} * {whole(f'{count} + 2')}) div {whole(f'{n} + 2 * {v}')}")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, at most 10^9 + 1 each, so that nothing leaves 64 bits."""
    p, q = (f"({c})" for c in (p, q))
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def terms(text: Column) -> Column:
    """Runs of letters and of what is beyond ASCII, only A-Z lower-cased: by lower() in texts where it does no more, which hold no other letter that it knows."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]")  # Cn: lower() may know more letters than the pattern does
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(ascii_lower(text)), BETWEEN), "")


def keyed_groups(rows: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, g) of each group of rows, and the seed of g: a hash of the two that no other group has."""
    groups, seed = cut(rows.groupBy("lang", "source").agg(F.lit(1).alias("one")), "groups").drop("one"), 0
    while True:
        keyed = groups.withColumn("g", group_key(seed))
        if keyed.count() == keyed.select("g").distinct().count():
            return keyed, seed
        seed += 1


def group_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", "source")


def learned(rows: DataFrame, min_docs: int, max_terms: int) -> list[tuple[CountVectorizerModel, list[str], DataFrame]]:
    """Models of all words in at least min_docs rows (g, words), each with its vocabulary and the rows with its share of the words.

    A vocabulary that reaches max_terms is not taken: words are dealt by their hash to twice as many vocabularies until each
    holds all its terms.
    """
    parts = 1
    while True:
        models = []
        for k in range(parts):
            mine = rows if parts == 1 else rows.withColumn("words", F.filter("words", lambda w: F.pmod(F.xxhash64(w), F.lit(parts)) == k))  # noqa: B023
            learn = CountVectorizer(inputCol="words", outputCol="counts", minDF=float(min_docs), vocabSize=min(max_terms, 2**31 - 1))
            # Words that no text has keep the vocabulary from being empty.
            model = learn.fit(mine.select("words").unionByName(rows.sparkSession.range(min_docs).select(F.array(F.lit("")).alias("words"))))
            words = model.vocabulary
            if len(words) >= max_terms:
                break
            models.append((model, words, mine))
        if len(models) == parts:
            return models
        parts *= 2


def group_sums(rows: DataFrame, min_docs: int = MIN_DOCS, max_terms: int = MAX_TERMS, own: int = OWN) -> tuple[DataFrame, DataFrame] | None:
    """rows (g, lang, text) as (g, t, n): occurrences of each kept term in each group that has it, and (t, term); None if no term is kept.

    A CountVectorizer per language learns its terms with minDF. That goes for the `own` languages with the most documents; the
    others lie side by side in one more, where each word carries its language, so that minDF still counts documents of that
    language only. The vectors are the exact counts of a document; they are written, and their entries added up by
    group, sparse as they are: no group is ever a dense vector. A language with fewer than min_docs documents keeps no term.
    """
    spark = rows.sparkSession
    many = rows.groupBy("lang").count().where(F.col("count") >= min_docs)
    langs = [r.lang for r in many.orderBy(F.desc("count"), "lang").limit(own).collect()]
    parts = [rows.where(F.col("lang") == x).select("g", terms(F.col("text")).alias("words")) for x in langs]
    if len(langs) == own:
        others = rows.where(~F.col("lang").isin(langs)) if langs else rows
        parts.append(others.select("g", F.transform(terms(F.col("text")), lambda w: F.concat(F.hex("lang"), F.lit(MARK), w)).alias("words")))
    sums = named = None
    for k, (model, words, mine) in enumerate(m for part in parts for m in learned(part, min_docs, max_terms)):
        if words == [""]:
            continue
        path = f"{shared_folder(spark)}/strandwork/vocabulary-{uuid.uuid4().hex}"
        number = lambda i: (F.lit(k << 32) + F.col(i)).alias("t")  # noqa: B023, E731
        listed = spark.createDataFrame([(words,)], "words array<string>").select(F.posexplode("words").alias("i", "word"))
        listed.where("word <> ''").select(number("i"), F.substring_index("word", MARK, -1).alias("term")).write.parquet(path)
        vectors = cut(model.transform(mine).select("g", "counts"), "vectors")
        # The files hold a sparse vector as the struct that it is.
        vectors = spark.read.schema("g long, counts struct<type:tinyint, size:int, indices:array<int>, values:array<double>>").parquet(*vectors.inputFiles())
        entries = vectors.select("g", F.explode(F.arrays_zip("counts.indices", "counts.values")).alias("e"))
        one = entries.groupBy("g", number("e.indices")).agg(F.sum("e.values").cast("long").alias("n"))
        sums, named = (one, spark.read.parquet(path)) if sums is None else (sums.unionByName(one), named.unionByName(spark.read.parquet(path)))
    return None if sums is None else (cut(sums, "sums"), named)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, max_terms: int = MAX_TERMS, own: int = OWN) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each group (language and source) from each other group of its language, and its own words.

    A group's share of a term is 1 + floor(10^9 (count + 2) / (all its counts + 2 terms)). Part `pair`: item is the other
    source, value the sum of floor((p - q)^2 / (p + q)) over all kept terms of the language. Part `term`: the `top`
    terms that the group has more often than its language, by that value. Ranks go by value, then item.

    Pairs are compared sparsely: terms that both groups have are met by a join on the term, added up before anything is
    shuffled; a term that one has meets the other's share of an absent term, once for each different count; what
    neither has is one product. Groups without terms count; null text, language and source are empty; repeated rows
    count each time; an empty table gives no rows; extra columns are not read.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(some(lang).alias("lang"), some(source).alias("source"), some(text).alias("text"))
    groups, seed = keyed_groups(rows)
    found = group_sums(rows.select(group_key(seed).alias("g"), "lang", "text"), min_docs, max_terms, own)
    if found is None:
        found = (docs.sparkSession.createDataFrame([], x) for x in ("g long, t long, n long", "t long, term string"))
    counts, words = found
    held = counts.groupBy("g").agg(F.sum("n").alias("own_n"), F.count("*").alias("k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    sizes = cut(groups.join(held, "g", "left").select("lang", "source", "g", zero("own_n"), zero("k")), "groups")
    # A term is its language's alone: one of its groups tells which.
    whole = cut(counts.join(sizes.select("g", "lang"), "g").groupBy("t").agg(F.sum("n").alias("whole"), F.first("lang").alias("lang")), "whole")
    langs = whole.groupBy("lang").agg(F.sum("whole").alias("lang_n"), F.count("*").alias("v"))
    sizes = sizes.join(langs, "lang", "left").select("lang", "source", "g", "own_n", "k", zero("lang_n"), zero("v"))
    sizes = cut(sizes.withColumn("z", F.when(F.col("v") > 0, share("0", "own_n", "v"))), "sizes")
    shares = cut(counts.join(sizes.select("g", "own_n", "v", "z"), "g").select("g", "t", share("n", "own_n", "v").alias("p"), "z"), "shares")

    a = shares.select("t", F.col("g").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    b = shares.select("t", F.col("g").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    f = apart
    both = a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("m"), F.sum(f("pa", "pb") - f("pa", "zb") - f("za", "pb")).alias("met"))
    # Each of a pair's groups against the other's share of what it lacks, by different shares of the first.
    kinds = shares.groupBy("g", "p").agg(F.count("*").alias("times")).join(sizes.select("g", "lang"), "g")
    other = sizes.select("lang", F.col("g").alias("o"), F.col("z").alias("zo"))
    alone = kinds.join(other, "lang").where("g <> o").groupBy(F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b")).agg(F.sum(f("p", "zo") * F.col("times")).alias("alone"))
    side = lambda x: sizes.select("lang", F.col("g").alias(x), F.col("source").alias(f"source_{x}"), F.col("k").alias(f"k{x}"), F.col("z").alias(f"z{x}"), F.col("v").alias(f"v{x}"))
    pairs = side("a").join(side("b"), "lang").where("a < b").join(both, ["a", "b"], "left").join(alone, ["a", "b"], "left")
    neither = (F.col("va") - F.col("ka") - F.col("kb") + F.coalesce("m", F.lit(0))) * F.coalesce(f("za", "zb"), F.lit(0))
    pairs = pairs.withColumn("value", F.coalesce("met", F.lit(0)) + F.coalesce("alone", F.lit(0)) + neither)
    ends = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = pairs.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    common = whole.join(langs, "lang").select("t", share("whole", "lang_n", "v").alias("q"))
    above = shares.join(common, "t").where("p > q").select("g", "t", f("p", "q").alias("value"))
    own = above.join(words, "t").join(sizes.select("g", "lang", "source"), "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(own.withColumn("rank", rank).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of every language and source."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
