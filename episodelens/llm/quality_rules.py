"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The ratio compares two multinomials over hashed n-grams: of a trusted target
and of the raw corpus.  n-grams are words and pairs of consecutive words.  A
document's log-likelihood ratio, divided by its number of n-grams, is thresholded
for every document.  Counts of the raw corpus cover all documents; the trusted
target may be a bounded, documented sample.  THRESHOLD was chosen by two-fold
cross-validation among trusted documents alone (README).

The learned table has BUCKETS values and is a literal of the plan.  Null, empty
and blank texts have no words and fail the base rules; texts of any length are
judged whole; repeated rows are judged each; an empty table gives no rows; other
columns are ignored.  An empty trusted target leaves the verdict to the base
rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents

#: Trusted documents at most; hash buckets; verdict: ratio per n-gram of at least THRESHOLD (five times the least of trusted documents that were left out of the target); smoothing.
TRUSTED, BUCKETS, THRESHOLD, SMOOTHING = 20_000, 16_384, -0.3, 1.0
LEAST_WORDS, WINDOW = 20, 8
_GAPS = "[ \\t\\n\\x0B\\f\\r]+"
_GAP_CHARS, _SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_GAP_CHARS))
    return F.when(bare == "", F.expr("array()").cast("array<string>")).otherwise(F.split(bare, _GAPS))


def _pairs(hashes: Column, step: int) -> Column:
    """Hashes of each element with the one `step` further on."""
    n = F.size(hashes) - step
    return F.when(n > 0, F.zip_with(F.slice(hashes, F.lit(1), F.greatest(n, F.lit(0))), F.slice(hashes, F.lit(step + 1), F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))).otherwise(F.expr("array()").cast("array<bigint>"))


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with _words, and hashes of its words (_h1) and of pairs of consecutive words (_h2)."""
    return docs.withColumn("_words", words_of(F.col("text"))).withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_h2", _pairs(F.col("_h1"), 1))


def bucket(n_gram: Column) -> Column:
    return F.pmod(n_gram, F.lit(BUCKETS)).cast("int")


def learn(docs: DataFrame, trusted_ids: DataFrame) -> list[float]:
    """Log-ratio of each bucket.  trusted_ids: doc_ids of the target, of bounded number."""
    flagged = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(trusted_ids.select(F.col("doc_id").alias("_id")).distinct()), F.col("doc_id") == F.col("_id"), "left")
    each = _hashed(flagged).select(F.col("_id").isNotNull().cast("long").alias("_good"), F.explode(F.concat("_h1", "_h2")).alias("h"))
    counts = each.groupBy(bucket(F.col("h")).alias("b")).agg(F.count("*").alias("raw"), F.sum("_good").alias("good")).collect()  # BUCKETS rows at most
    raw, good = sum(r.raw for r in counts), sum(r.good for r in counts)
    out = [0.0] * BUCKETS
    for r in counts if good else ():
        out[r.b] = math.log((r.good + SMOOTHING) / (good + SMOOTHING * BUCKETS)) - math.log((r.raw + SMOOTHING) / (raw + SMOOTHING * BUCKETS))
    return out


def judge(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio."""
    text = F.coalesce(F.col("text"), F.lit(""))
    logs = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # one literal, folded when planned
    total = lambda hashes: F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.get(logs, bucket(h)))
    df = _hashed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).withColumn("_h4", _pairs(F.col("_h2"), 2))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    df = df.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        (total(F.col("_h1")) + total(F.col("_h2"))).alias("_sum"),
        (F.size("_h1") + F.size("_h2")).alias("_grams"),
        # a repeated 8-word window repeats its first 4 words: few texts go on from here
        F.when(F.size(F.array_distinct("_h4")) < F.size("_h4"), F.col("_h4")).alias("_h4"),
    )
    df = df.withColumn("_h8", F.when(F.col("_h4").isNotNull(), _pairs(F.col("_h4"), 4)))
    df = df.withColumn("_h8", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.col("_h8"))).drop("_h4")
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    # only texts with a repeated window sort their windows
    df = df.withColumn("_sorted", F.when(F.col("_h8").isNotNull(), F.array_sort(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i, k: F.coalesce(F.get(F.col("_sorted"), i + k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])))
    step = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1), p + WINDOW) - p))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    df = df.withColumn("ratio", F.col("_sum") / F.greatest("_grams", F.lit(1)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"), "ratio")


def trusted_sample(labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """doc_ids labelled of good quality, at most bound, chosen by hash."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, learn(docs, trusted_sample(documents(spark, sf_dir, "labels"))))
