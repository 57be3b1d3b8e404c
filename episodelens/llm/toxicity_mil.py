"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is logistic in its hashed
words; the document's is their noisy-or, 1 - prod(1 - p).  The weights are
trained on document labels alone, by adaptive gradient steps on the bag's
log-likelihood with an L1 penalty, so that only telling words keep weight;
then the sentences over a threshold are located.

Sentences end after . ! ? or a line break.  A null or empty text has no
sentence and score 0; a null doc_id is never learned from and isn't held out;
without both labels in the sample every score is under 1e-9.  Other columns are
ignored, repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import labelled_sample, remainder
from ._shared import documents
from ._text import _LOWER, U64, Words, batches_of, mix

#: At most so many labelled rows are learned from.
SAMPLE = 6000
BITS, CUT = 18, 0.7
_END = np.isin(np.arange(256), list(b".!?\n"))
_WORD = np.isin(_LOWER, list(b"abcdefghijklmnopqrstuvwxyz0123456789")) | (np.arange(256) >= 128)


def bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sentence of each bare word; document of each sentence; first byte of each sentence (and the end)."""
    data, offsets = words.data, words.offsets
    # the words here are runs of letters and digits, so that punctuation doesn't split a word's identity
    bare = Words.__new__(Words)
    bare.data, bare.offsets = data, offsets
    inside = _WORD[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts], finishes[cuts - 1] = inside[cuts], inside[cuts - 1]
    bare.starts, bare.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    bare.first = np.searchsorted(bare.starts, offsets)
    stops = np.union1d(np.flatnonzero(_END[data]) + 1, offsets[1:])
    sentence = np.searchsorted(stops, bare.starts, "right")
    used, sentence = np.unique(sentence, return_inverse=True)
    begin = np.concatenate([[0], stops])[used]
    doc = np.searchsorted(offsets, begin, "right") - 1
    # each word gives its own hash and those of its first and last bytes, so that inflected words meet
    ends, starts, tokens = bare.ends, bare.starts, []
    for kind, (a, b) in enumerate(((starts, ends), (starts, np.minimum(starts + 4, ends)), (starts, np.minimum(starts + 5, ends)), (np.maximum(ends - 5, starts), ends))):
        bare.starts, bare.ends = a, b
        tokens.append((mix(bare.hashes(lower=True) + U64(kind)) >> U64(64 - BITS)).astype(np.int32))
    bucket, sentence = np.concatenate(tokens), np.tile(sentence, len(tokens))
    return bucket, sentence, doc, np.stack([begin, stops[used]], 1) if len(used) else np.zeros((0, 2), np.int64)


def _distinct(bucket: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(sentence.astype(np.int64) << BITS | bucket)
    return (key & ((1 << BITS) - 1)).astype(np.int32), key >> BITS


def _frequencies(batches):
    """Of each bucket: the task's bags that hold it, and those labelled 1; bucket -1 counts all bags."""
    n, good, seen, toxic = 0, 0, np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for part, words in batches_of(batches):
        bucket, sentence, doc, _ = bags(words)
        y = part.column("y").to_numpy() == 1
        once = np.unique(doc[sentence].astype(np.int64) << BITS | bucket) if len(doc) else np.zeros(0, np.int64)
        key, bag = once & ((1 << BITS) - 1), once >> BITS
        seen += np.bincount(key, minlength=1 << BITS)
        toxic += np.bincount(key[y[bag]], minlength=1 << BITS)
        n, good = n + len(y), good + int(y.sum())
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(seen[used], n), pa.int64()), pa.array(np.append(toxic[used], good), pa.int64())], ["bucket", "seen", "toxic"])


def telling_words(n: int, good: int, seen: np.ndarray, toxic: np.ndarray, least: int = 3, lift: float = 3.5) -> np.ndarray:
    """Buckets in `least` bags or more that are by `lift` standard errors commoner in bags labelled 1."""
    share, rate = seen / max(n, 1), good / max(n, 1)
    score = (toxic - share * good) / np.sqrt(np.maximum(n * share * (1 - share) * rate * (1 - rate), 1e-12))
    return np.flatnonzero((seen >= least) & (score >= lift))


def _bag_rows(used):
    """Per bag: y, its number of sentences, and its telling words with their sentences."""

    def run(batches):
        local = np.full(1 << BITS, -1, np.int32)
        local[used] = np.arange(len(used))
        for part, words in batches_of(batches):
            bucket, sentence, doc, _ = bags(words)
            size = np.bincount(doc, minlength=part.num_rows)
            first = np.cumsum(size) - size
            keep = local[bucket] >= 0
            word, sentence = _distinct(local[bucket[keep]], sentence[keep])
            bounds = np.searchsorted(doc[sentence], np.arange(part.num_rows + 1)) if len(doc) else np.zeros(part.num_rows + 1, int)
            pairs = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(size, pa.int32()), pa.array([word[i:j].tobytes() for i, j in pairs], pa.binary()), pa.array([(sentence[i:j] - f).astype(np.int32).tobytes() for (i, j), f in zip(pairs, first, strict=True)], pa.binary())], ["y", "size", "words", "sentences"])

    return run


def sentence_logits(w: np.ndarray, b: float, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(sentence, w[bucket], n) + b


def bag_scores(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Noisy-or of the sentences of each bag."""
    return -np.expm1(-np.bincount(doc, np.logaddexp(0, np.clip(z, -40, 40)), n))


def fit(y: np.ndarray, sizes: np.ndarray, words: list[np.ndarray], sentences: list[np.ndarray], n_words: int, rounds: int = 400, rate: float = 0.5, l1: float = 5e-6) -> tuple[np.ndarray, float]:
    """Weights of the telling words, and the bias."""
    v, b, squares, b_square = np.zeros(n_words), -5.0, np.full(n_words, 1e-8), 1e-8
    if len(set(y.tolist())) < 2 or not n_words:
        return v, -40.0
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    local = np.concatenate(words)
    sentence = np.concatenate(sentences) + np.repeat(base[:-1], [len(x) for x in words])
    doc = np.repeat(np.arange(len(y)), sizes)
    n, m = len(y), len(doc)
    for _ in range(rounds):
        z = np.bincount(sentence, v[local], m) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        whole = np.clip(bag_scores(z, doc, n), 1e-9, 1)
        slope = p * np.where(y[doc] == 1, -(1 - whole[doc]) / whole[doc], 1.0) / n
        g = np.bincount(local, slope[sentence], n_words)
        squares += g * g
        step = rate / np.sqrt(squares)
        v = v - step * g
        v = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
        gb = slope.sum()
        b_square += gb * gb
        b = min(-2.0, b - rate * gb / np.sqrt(b_square))
    return v, float(b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, locate: float = 0.5) -> DataFrame:
    """docs' doc_id with held_out, score, predicted and offending: sentences (byte span, score) of at least `locate`."""
    rows = labelled_sample(docs, labels, "toxic", remainder(3) != 1, sample).select("text", "y")
    # executors add up; the driver gets a row for each bucket at most
    counts = rows.mapInArrow(_frequencies, "bucket int, seen long, toxic long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()
    bucket, some, bad = (counts.column(c).to_numpy() for c in ("bucket", "seen", "toxic"))
    seen, toxic = np.zeros((1 << BITS) + 1, np.int64), np.zeros((1 << BITS) + 1, np.int64)
    seen[bucket], toxic[bucket] = some, bad  # bucket -1 is the last one
    used = telling_words(int(seen[-1]), int(toxic[-1]), seen[:-1], toxic[:-1])
    got = rows.mapInArrow(_bag_rows(used), "y int, size int, words binary, sentences binary").toPandas()
    got = got.sort_values(["y", "size", "words", "sentences"], kind="stable")
    v, b = fit(got.y.to_numpy(), got["size"].to_numpy(), [np.frombuffer(x, np.int32) for x in got.words], [np.frombuffer(x, np.int32) for x in got.sentences], len(used))
    model = (used[v != 0].astype(np.int32), v[v != 0])

    def score(batches):
        weights = np.zeros(1 << BITS)
        weights[model[0]] = model[1]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for part, words in batches_of(batches):
            bucket, sentence, doc, spans = bags(words)
            bucket, sentence = _distinct(bucket, sentence)
            z = sentence_logits(weights, b, bucket, sentence, len(doc))
            whole = bag_scores(z, doc, part.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for i in np.flatnonzero(p >= locate):
                at = int(words.offsets[doc[i]])
                found[doc[i]].append({"start": int(spans[i, 0]) - at, "end": int(spans[i, 1]) - at, "score": float(p[i])})
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(whole), pa.array(found, kind)], ["doc_id", "held_out", "score", "offending"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(score, "doc_id long, held_out boolean, score double, offending array<struct<start: bigint, end: bigint, score: double>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "offending")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))
