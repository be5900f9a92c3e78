"""URL filters: host and path rules, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from importlib.resources import files

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Rules of the query: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Buckets of the hashed n-grams; their lengths; the most rows that a model is fitted on.
BUCKETS, SIZES, MAX_LABELLED = 4096, (3, 4), 20_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where there is no `://`."""
    whole, pattern = F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, else null.

    A rule fits its host and all its subdomains if the path starts with the rule's. The rules are a short list
    (they become one expression); of rules of equal length the first in code-point order wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_ngrams(df: DataFrame, host: Column, path: Column, name: str) -> DataFrame:
    """df plus the buckets (from 0) of the distinct character n-grams of `^host$` and `^path$`; host's and path's are kept apart."""
    def grams(mark: str, chars: str, n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.hash(F.lit(mark), *[F.get(chars, i + k) for k in range(n)]), F.lit(BUCKETS)))

    def letters(part: Column) -> Column:
        return F.split(F.concat(F.lit("^"), ascii_lower(part), F.lit("$")), "")

    df = df.withColumns({f"{name}_h": letters(host), f"{name}_p": letters(path)})
    parts = [grams(mark, f"{name}_{mark}", n) for mark in "hp" for n in SIZES]
    return df.withColumn(name, F.array_distinct(F.concat(*parts))).drop(f"{name}_h", f"{name}_p")


def labelled_urls(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The small labelled table (url, label 1 = block): the package's own file of some 1,100 rows, or a CSV file at a path that Spark can read."""
    if path is not None:
        return spark.read.option("header", True).schema("url string, label double").csv(path)
    with files(__package__).joinpath("labelled_urls.csv").open(newline="") as f:
        rows = [(r["url"], float(r["label"])) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "url string, label double")


def held_out_scores(labelled: DataFrame, fold: int = 0, folds: int = 5) -> DataFrame:
    """(url, label, score): the labelled urls of one fold, by a hash of the url, scored by a model that is fitted on the others."""
    dealt = labelled.withColumn("_fold", F.pmod(F.xxhash64("url"), F.lit(folds)))
    model = fit(dealt.where(F.col("_fold") != fold).select("url", "label"))
    return filter_urls(dealt.where(F.col("_fold") == fold).select("url", "label"), model, rules=()).select("url", "label", "score")


def fit(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> list[float]:
    """Coefficients by bucket, then the intercept, of a logistic regression fitted on (url, label).

    A labelled table of over max_rows rows is cut to those with the smallest url hashes: the fit is a bounded job.
    """
    host, path = url_parts(F.col("url"))
    rows = labelled.select(host.alias("host"), path.alias("path"), "label", F.xxhash64("url").alias("h"), "url").orderBy("h", "url").limit(max_rows)
    hits = cut(with_ngrams(rows, F.col("host"), F.col("path"), "grams").select("label", "grams"), "urls")
    dense = hits.select("label", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.array_contains("grams", i).cast("double"))).alias("features"))
    model = LogisticRegression(regParam=0.0005, maxIter=50, standardization=False).fit(dense)
    return [*model.coefficients.toArray().tolist(), float(model.intercept)]


def filter_urls(pages: DataFrame, weights: list[float], rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, url: str = "url") -> DataFrame:
    """All columns of pages, and host, path, rule, score (of the model) and verdict (the rule's, else block from the threshold on).

    Null urls and such without `://` have an empty host and path; the model judges them too. Repeated rows are judged
    alike, an empty table gives none. Columns of pages by one of the five names are replaced. One narrow pass: no shuffle, no Python; the weights are one constant array.
    """
    host, path = url_parts(F.col(url))
    model = F.from_json(F.lit("[" + ",".join(f"{w:.9g}" for w in weights[:-1]) + "]"), "array<double>")
    judged = pages.drop("path", "host").withColumns({"host": host, "path": path})
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    margin = F.aggregate("_grams", F.lit(float(weights[-1])), lambda s, g: s + F.get(model, g))
    judged = with_ngrams(judged, F.col("host"), F.col("path"), "_grams").withColumns({"rule": rule, "verdict": verdict, "score": F.round(1 / (1 + F.exp(-margin)), 6)}).drop("_grams")
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by the model that is fitted on the small labelled table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, fit(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")
