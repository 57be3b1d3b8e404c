"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams of code points (as they are, not
lower-cased) by language, add-one smoothed, give a matrix of log-probabilities
with a row for each slot; it is broadcast (it grows with the languages learned,
not with the documents) and whole texts are scored in numpy.  score is the
posterior of the chosen language, at a temperature of the square root of the
gram count.

A text that is null or has no letter gives `und` and score 0; so does every
text where nothing could be learned.  Ties go to the first language by name;
damaged UTF-8 counts as U+FFFD and changes no other text's result; repeated
rows are learned from and scored each; an empty table gives no rows; a null
doc_id isn't learned from and isn't held out; other columns pass through,
whatever their names, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import remainder
from ._shared import documents, sealed
from ._text import repaired, slices, string_buffers

#: At most so many labelled documents are learned from, whole texts each.
SAMPLE = 20_000
BITS = 14
_ORDERS = (1, 2, 3)


def gram_slots(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of a run of documents, with each one's document.  bounds: byte bounds of documents."""
    raw, bounds = repaired(data, bounds)
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    slots, owners = [], []
    key = np.zeros(len(codes), np.uint32)
    for n in _ORDERS:
        key = key[: len(codes) - n + 1] * np.uint32(0x01000193) + (codes[n - 1 :] + np.uint32(n)) if len(codes) >= n else key[:0]
        same = docs[: len(key)] == docs[n - 1 :] if len(key) else np.zeros(0, bool)
        mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        slots.append((mixed >> np.uint32(32 - BITS))[same])
        owners.append(docs[: len(key)][same])
    return np.concatenate(slots).astype(np.int64), np.concatenate(owners)


def _counts(batches):
    """The task's gram counts by language and slot; slot -1 counts documents."""
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        names = batch.column("lang").to_pylist()
        known = sorted(set(names))
        index = {x: i for i, x in enumerate(known)}
        code = np.array([index[x] for x in names])
        data, offsets = string_buffers(batch.column("text"))
        for a, b in slices(offsets):
            slots, owner = gram_slots(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            part = np.bincount(code[a:b][owner] * (1 << BITS) + slots, minlength=len(known) << BITS).reshape(len(known), -1)
            for i, x in enumerate(known):
                total[x] = total.get(x, 0) + part[i]
        for x in names:
            docs[x] = docs.get(x, 0) + 1
    for x, counts in total.items():
        used = np.flatnonzero(counts)
        slot, n = np.append(used, -1), np.append(counts[used], docs[x])
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(n, pa.int64())], ["lang", "slot", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (prior last).  Executors add up the counts; the driver gets a row for each language and slot."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang is not null").where(remainder(5) != 0)
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = rows.join(F.broadcast(chosen), "doc_id").where("text is not null").select("lang", "text")
    got = rows.mapInArrow(_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    lang, slot, n = (got.column(c).to_numpy() for c in ("lang", "slot", "n"))
    known = sorted(set(lang.tolist()))
    table = np.zeros(((1 << BITS) + 1, len(known)), np.float32)
    every = n[slot < 0].sum()
    for i, x in enumerate(known):
        counts = np.zeros(1 << BITS, np.int64)
        own = lang == x
        counts[slot[own & (slot >= 0)]] = n[own & (slot >= 0)]
        table[:-1, i] = np.log(counts + 1.0) - np.log(counts.sum() + (1 << BITS))
        table[-1, i] = np.log(n[own & (slot < 0)].sum() / every)
    return known, table


def predict(docs: DataFrame, known: list[str], table: np.ndarray) -> DataFrame:
    """docs with lang_pred and score; all its columns stay."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known, table))

    def score(batches):
        names, logs = shared.value
        for batch in batches:
            n = batch.num_rows
            z, grams = np.zeros((n, max(1, len(names)))), np.zeros(n)
            data, offsets = string_buffers(batch.column("text"))
            for a, b in slices(offsets):
                slots, owner = gram_slots(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                grams[a:b] = np.bincount(owner, minlength=b - a)
                for i in range(len(names)):
                    z[a:b, i] = np.bincount(owner, logs[:-1, i][slots], b - a) + logs[-1, i]
            letters = batch.column("_letters").to_numpy(zero_copy_only=False) & bool(names)
            best = z.argmax(1)
            p = 1 / np.exp((z - z.max(1, keepdims=True)) / np.sqrt(np.maximum(grams, 1))[:, None]).sum(1)
            pred = [names[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(np.where(letters, p, 0.0))], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    stay = [i for i, c in enumerate(docs.columns) if c not in ("lang_pred", "score")]
    rows, names = sealed(docs, ("text",))
    names, columns = [names[i] for i in stay], [docs.columns[i] for i in stay]
    base = rows.select(*names).withColumn("text", F.col("text").cast("string"))
    full = base.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return full.mapInArrow(score, f"{kind}, lang_pred string, score double").toDF(*columns, "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known, table = train(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "text")
    return predict(texts, known, table).select("doc_id", "held_out", "lang_pred", "score")
