"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A document's strength is a linear function of its features.  Each pair of a
document labelled 1 and one labelled 0 is a preference; the weights minimise
the mean logistic loss of feature differences over all pairs of all labelled
documents that aren't held out (``_pairs``: no pair or row is drawn).  Scores are
cut at the exact quantile of all training strengths: the share of documents
labelled 0.  The score maps that cut to ``CUT`` on the logistic curve, so score
>= CUT is the verdict.  Weights are rounded to ``DIGITS`` places, below which sums
depend on the order of rows.

Features come from the text alone: shares of hashed words and character pairs,
of character classes, word and line shapes, and repetition.  Null or empty texts
have all features 0 and a score as any other; a null doc_id is never learned from
and isn't held out; labels but 0 and 1 aren't learned from; without both labels
every score is 0.5; texts of any length are scored whole.  Other columns are ignored, repeated rows are
scored each, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import label_rows, remainder
from ._pairs import arrays, order_keys, quantiles, strengths, totals_over, weights_of_all_pairs
from ._shared import Tables, documents
from ._text import SEPARATOR, U64, Runs, batches_of

#: Hashed buckets of byte pairs and of words; verdict cut.
BUCKETS, WORD_BITS, CUT = 64, 7, 0.3
#: Penalty of weights; their decimal places.
RIDGE, DIGITS = 1e-3, 7
_CLASSES = [np.isin(np.arange(256), list(c)) for c in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!", b"?", b"|", b"#*$%&<>", b"()[]{}", b"@", b"/\\", b"-_=+~", b"'\"`", b"\n", bytes(range(128, 256)))]
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) | (np.arange(256) >= 128)
N_FEATURES = len(_CLASSES) + 10 + BUCKETS + (1 << WORD_BITS)


def features(words) -> np.ndarray:
    """A row of features for each document of a slice."""
    data, offsets, first = words.data, words.offsets, words.first
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    if not len(data):
        return out
    bounds = np.diff(offsets)
    size = np.maximum(bounds, 1).astype(float)
    doc_of_byte = np.repeat(np.arange(n), bounds)
    per_doc = lambda at, of=doc_of_byte: np.bincount(of[at], minlength=n)
    counts = np.bincount(doc_of_byte * 256 + data, minlength=n * 256).reshape(n, 256)
    for k, c in enumerate(_CLASSES):
        out[:, k] = np.sqrt(counts[:, c].sum(1) / size)
    k = len(_CLASSES)
    count = np.diff(first)
    many = np.maximum(count, 1).astype(float)
    length = words.ends - words.starts
    doc_of_word = np.repeat(np.arange(n), count)
    out[:, k] = np.log1p(count)
    mean = np.bincount(doc_of_word, length, n) / many
    out[:, k + 1] = mean / 10
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(doc_of_word, length.astype(float) ** 2, n) / many - mean**2, 0)) / 10
    bare = ~(_LETTER[data[words.starts]] if len(words) else np.zeros(0, bool))
    out[:, k + 3] = np.sqrt(np.bincount(doc_of_word, bare, n) / many)
    ended = ~(_LETTER[data[words.ends - 1]] if len(words) else np.zeros(0, bool))
    out[:, k + 4] = np.sqrt(np.bincount(doc_of_word, ended, n) / many)
    hashes = words.hashes(lower=True)
    distinct = lambda values, docs: np.bincount(np.unique(np.stack([docs.astype(np.uint64), values], 1), axis=0)[:, 0].astype(np.int64), minlength=n)
    order = np.lexsort((hashes, doc_of_word))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc_of_word[order][1:] != doc_of_word[order][:-1])
    out[:, k + 5] = (count - np.bincount(doc_of_word[order][new], minlength=n)) / many
    # lines: share of lines equal to another one, by hashes of their words
    brk = np.flatnonzero(data == 10)
    line_of_word = np.searchsorted(brk, words.starts) + doc_of_word
    starts = np.flatnonzero(np.concatenate([[True], line_of_word[1:] != line_of_word[:-1]])) if len(words) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(words)]])[: len(starts)]
    lines, line_doc = Runs(hashes).of(starts, ends - starts), doc_of_word[starts] if len(words) else starts
    total = np.bincount(line_doc, minlength=n)
    out[:, k + 6] = (total - distinct(lines, line_doc)) / np.maximum(total, 1)
    out[:, k + 7] = np.log1p(total)
    wide = np.zeros(len(data), bool)
    same = doc_of_byte[:-1] == doc_of_byte[1:]
    wide[:-1] = (data[1:] == data[:-1]) & ~SEPARATOR[data[1:]] & same
    out[:, k + 8] = np.sqrt(per_doc(np.flatnonzero(wide)) / size)
    out[:, k + 9] = bounds > 0
    pair = (data[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(26)
    grams = np.bincount(doc_of_byte[:-1][same] * BUCKETS + pair[same], minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, k + 10 : k + 10 + BUCKETS] = np.sqrt(grams / size[:, None])
    slot = (hashes >> U64(64 - WORD_BITS)).astype(np.int64)
    out[:, k + 10 + BUCKETS :] = np.sqrt(np.bincount(doc_of_word << WORD_BITS | slot, minlength=n << WORD_BITS).reshape(n, -1) / many[:, None])
    return out


def _feature_rows(batches):
    for part, words in batches_of(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in features(words).astype(np.float32)], pa.binary())], ["doc_id", "x"])


def _scale(good: float, bad: float) -> float:
    """Of scores, by the median strengths of either label."""
    return 2.0 / max(good - bad, 1e-9)


def fit(x: np.ndarray, y: np.ndarray, pairs: int | None = None, ridge: float = RIDGE, rounds: int = 25) -> tuple[np.ndarray, float, float]:
    """Weights, cut and scale of rows in memory: over all pairs, or by Newton steps on so many drawn ones (for comparisons; no query draws any)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), 0.0, 0.0
    if pairs is None:
        w = weights_of_all_pairs(lambda kernel, *more: kernel(x, y, *more), ridge)[0]
    else:
        rng = np.random.default_rng(7)
        spread = x.std(0)
        spread[spread < 1e-9] = 1
        d = (x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]) / spread
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = d.T @ (p - 1) / pairs + ridge * w
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        w /= spread
    strength = x @ w
    return w, float(np.quantile(strength, len(bad) / len(y))), _scale(float(np.median(strength[good])), float(np.median(strength[bad])))


def learn(docs: DataFrame, labels: DataFrame, ridge: float = RIDGE) -> tuple[np.ndarray, float, float] | None:
    """Weights, cut and scale from all labelled documents that aren't held out; None without both labels.

    Features, not texts, meet the labels; they are written once, and each pass
    over them sends the driver sums of a fixed size.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "quality")
    usable = remainder(5) != 0
    known = tables.keep(label_rows(labels, "quality", usable).where("y in (0, 1)"), "labels", ["doc_id"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").where(usable)
    rows = tables.keep(texts.mapInArrow(_feature_rows, "doc_id long, x binary").join(known, "doc_id").select("y", "x"), "features")
    found = weights_of_all_pairs(totals_over(rows, max(2, spark.sparkContext.defaultParallelism)), ridge)
    if found is None:
        tables.drop()
        return None
    w, n_good, n_bad = np.round(found[0], DIGITS), *found[1:]

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(order_keys(strengths(arrays(batch)[0], w)))], ["y", "key"])

    keyed = tables.keep(rows.mapInArrow(keys, "y int, key long"), "strengths", ["key"])
    n = n_good + n_bad
    cut, good, bad = quantiles(keyed, [([0, 1], n_bad / n, n), ([1], 0.5, n_good), ([0], 0.5, n_bad)])
    tables.drop()
    return w, cut, _scale(good, bad)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' doc_id with held_out, score and predicted."""
    model = learn(docs, labels)
    w, cut, scale = model or (np.zeros(N_FEATURES), 0.0, 0.0)
    shift = float(np.log(CUT / (1 - CUT))) if model else 0.0

    def score(batches):
        for part, words in batches_of(batches):
            z = np.clip((strengths(features(words).astype(np.float32).astype(float), w) - cut) * scale * 2 + shift, -40, 40)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "held_out", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
