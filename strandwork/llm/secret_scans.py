"""Secret scans: patterns with spans, and how many owners and repositories hold each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Kinds in order, their patterns (Java), the group whose length counts, and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Words one of which each match of the first pattern holds, for a cheap test first.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Candidates of the method: runs of these characters with digits and letters; added as spans of this kind.
CANDIDATE, ADDED = r"[A-Za-z0-9_-]{20,}", "owned"
#: Matches of a run.
RUN = 32
#: A candidate is live-looking from so many digits and distinct characters on; a value is owner-specific up to so many owners and repositories.
MIN_DIGITS, MIN_DISTINCT, MAX_OWNERS, MAX_REPOS = 3, 10, 1, 3


def with_spans(df: DataFrame, name: str, test: Column, pattern: str, group: int, least: int) -> DataFrame:
    """df plus name: array of (start, end, value) of the matches in _text, leftmost and non-overlapping; those whose group is shorter than least are dropped.

    Java's split() and find-all walk the same matches: the pieces between them and the matches themselves, laid
    end to end, are the text, so the running sum of their lengths gives the positions, in code points. It is made within
    runs of RUN matches and over the runs, since a fold copies its state at each step; so time is about in proportion to the
    matches. Each step is a column of its own that the next one reads more than once or as a whole: so none is made again.
    """
    text = F.col("_text")
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    runs = F.sequence(F.lit(0), F.expr(f"int((size(_length) - 1) div {RUN})"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    df = df.withColumn("_parts", F.when(test, parts))
    df = df.withColumn("_length", F.transform("_parts", lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))))
    df = df.withColumn("_sums", F.transform(runs, lambda r: total(F.slice("_length", r * RUN + 1, RUN))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    df = df.withColumn("_from", F.aggregate("_sums", start, lambda s, v: F.struct((s["at"] + v).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"]))
    within = lambda at, r: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size("_length") - r * RUN)), lambda i: at + total(F.slice("_length", r * RUN + 1, i)))
    df = df.withColumn("_ends", F.flatten(F.transform("_from", within)))
    found = F.zip_with("_parts", "_ends", lambda x, end: F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["value"].alias("value")))
    found = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return df.withColumn(name, F.coalesce(found, F.array().cast("array<struct<start:int,end:int,value:string>>"))).drop("_parts", "_length", "_sums", "_from", "_ends")


def scan(docs: DataFrame) -> DataFrame:
    """docs plus `found`: array of (start, kind_no, end, value) of the base spans and, as the last kind, of candidates. Row by row, whole texts."""
    low = F.lower("_text")
    tests = [low.contains(HINTS[0])]
    for hint in HINTS[1:]:
        tests[0] = tests[0] | low.contains(hint)
    tests += [F.col("_text").contains("AKIA"), F.col("_text").rlike(KINDS[2][1]), F.col("_text").rlike(r"\d") & F.col("_text").rlike(CANDIDATE)]
    df = docs
    for i, (kind, pattern, group, least) in enumerate((*KINDS, (ADDED, CANDIDATE, 0, 20))):
        df = with_spans(df, f"_{kind}", tests[i], pattern, group, least)
    live = lambda v: (F.length(F.regexp_replace(v, r"\D+", "")) >= MIN_DIGITS) & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT)
    df = df.withColumn(f"_{ADDED}", F.filter(f"_{ADDED}", lambda x: live(x["value"])))
    kinds = [*(k for k, *_ in KINDS), ADDED]

    def numbered(i: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind_no"), x["end"].alias("end"), x["value"].alias("value")))

    found = F.concat(*[numbered(i, k) for i, k in enumerate(kinds)])
    return df.withColumn("found", found).drop(*[f"_{k}" for k in kinds])


def spell(found: Column) -> Column:
    """kind:start:end of each span by start, then kind as listed; comma-joined."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit(ADDED))
    return F.array_join(F.transform(F.sort_array(found), lambda x: F.concat_ws(":", F.get(names, x["kind_no"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied, n_base_live, n_base_copied, max_repos.

    Base spans come from the patterns alone. The values of base spans and candidates (long mixed runs) are hashed; over
    the whole corpus each hash's distinct owners and repositories are counted. A value with at most max_owners owners
    and max_repos repositories is taken for a live credential of that owner, one that more hold for a copied example.
    A live candidate's span is added unless a base span has the same bounds (n_owned); a copied one has no span
    (n_copied). Base spans always stay; n_base_live and n_base_copied tell their values apart. max_repos is the most
    repositories of any of the row's values. Null texts are empty; a null owner or repository counts as one of its own,
    apart from an empty one; repeated rows each get their own row (their id is made in the written scan).

    Texts are read once; the scan's spans (small) are written to the shared folder. Counting starts within each
    task, so that a hash in a third of all documents shuffles a few rows; the join back has one row per hash on
    its right side, and a hot left side can be split.
    """
    told = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), owner.alias("owner"), repository.alias("repo"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kept = cut(scan(rows).drop("_text").withColumns({"row": F.monotonically_increasing_id(), "owner": told("owner"), "repo": told("repo")}), "secrets")
    last = len(KINDS)
    base = F.filter("found", lambda x: x["kind_no"] < last)
    hits = kept.select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", "x", F.sha2("x.value", 256).alias("hash"))
    freq = hits.select("hash", "owner", "repo").distinct().groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.count("repo").alias("n_repos"))
    known = hits.select("row", "x", "hash").join(freq, "hash")
    live, added_kind = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos), F.col("x.kind_no") == last
    by_row = known.groupBy("row").agg(
        F.collect_list(F.when(live & added_kind, F.col("x"))).alias("owned"), F.count_if(live & added_kind).alias("n_owned"), F.count_if(~live & added_kind).alias("n_copied"),
        F.count_if(live & ~added_kind).alias("n_base_live"), F.count_if(~live & ~added_kind).alias("n_base_copied"), F.max("n_repos").alias("max_repos"),
    )
    out = kept.select("row", "doc_id", base.alias("base")).join(by_row, "row", "left")
    # Bounds as whole numbers: those are told apart by hash, structs one by one.
    bounds = lambda spans: F.transform(spans, lambda x: F.shiftleft(x["start"].cast("long"), 31) + x["end"])
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,value:string>>")
    alone = F.array_except(bounds(F.coalesce("owned", none)), bounds("base"))
    added = F.transform(alone, lambda b: F.struct(F.shiftright(b, 31).cast("int").alias("start"), F.lit(last).alias("kind_no"), (b % (1 << 31)).cast("int").alias("end"), F.lit("").alias("value")))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind_no"] == i)).cast("long")
    return out.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)], F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.concat("base", added)).alias("spans"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_owned", "n_copied", "n_base_live", "n_base_copied", "max_repos")],
    )


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; its owner is its source, its repository the source's part in one language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
