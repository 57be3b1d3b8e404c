"""Mixing sources to target weights by Pfair scheduling.

Each source is a run of blocks of equal text volume.  With target weight w the
k-th block (k = 0, 1, ...) is released at slot floor(k / w) and due at
ceil((k + 1) / w); earliest deadline first over unit slots meets all deadlines
on one processor, so at every moment each source is within one block of its
share.  Weights are held as integers q of a period Q = sum(q): the schedule
repeats every Q slots, so one period is computed and blocks take their slot by
arithmetic, however many there are.  When a source ends, a phase ends and the
others go on at their relative weights; there are as many phases as sources at
most, and nothing is dropped.

A document belongs to the block where it starts, in order of doc_id within the
source.  Documents are dealt by ranges of (source, doc_id, ...) that Spark
balances by sampling, so one source's documents, or those without a doc_id, are
numbered by many tasks; sums of ranges place each range.  Null sources are a
source of their own, null or negative sizes count as 0, an empty text takes no
volume; ties of doc_id are ordered by the text's hash, then by size, then by
place in the input (such rows are alike); null doc_ids come first; an empty table
gives an empty plan; other columns are ignored.  The plan is held by the driver
and broadcast: it grows with the square of the number of sources, not with the
documents.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Tables, documents

#: Code points of a block; slots of a period (sources get one at least); rows of a numbering range at most, on average; weight exponent.
BLOCK_CHARS, PERIOD, RANGE_ROWS, EXPONENT = 100_000, 1000, 2_000_000, 0.5


def integer_weights(weights: np.ndarray, period: int = PERIOD) -> np.ndarray:
    """Weights as positive integers that sum to the period (or to the number of sources, if larger), by largest remainder."""
    share = np.asarray(weights, float)
    share = share / share.sum() if share.sum() > 0 else np.full(len(share), 1 / max(len(share), 1))
    period = max(period, len(share))
    exact = share * (period - len(share))
    q = np.floor(exact).astype(np.int64)
    left = period - len(share) - q.sum()
    q[np.argsort(-(exact - q), kind="stable")[:left]] += 1
    return q + 1


def edf_period(q: np.ndarray) -> np.ndarray:
    """Source of each slot of a period: earliest deadline first among released blocks, ties to the first source."""
    period = int(q.sum())
    release = lambda s, k: k * period // int(q[s])
    due = lambda s, k: -(-(k + 1) * period // int(q[s]))
    waiting, ready, out = [(0, s, 0) for s in range(len(q))], [], np.empty(period, np.int64)
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        out[t] = s
        if k + 1 < q[s]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
    return out


def phases(blocks: np.ndarray, weights: np.ndarray, period: int = PERIOD) -> list[dict]:
    """Phases of the schedule: active sources, their q, done (blocks before it), start slot, length, period pattern."""
    done, start, out = np.zeros(len(blocks), np.int64), 0, []
    while (active := np.flatnonzero(blocks > done)).size:
        q = integer_weights(weights[active], period)
        pattern = edf_period(q)
        size = len(pattern)
        slots = [np.flatnonzero(pattern == i) for i in range(len(active))]
        left = (blocks - done)[active]
        last = np.array([(r - 1) // int(q[i]) * size + int(slots[i][(r - 1) % int(q[i])]) for i, r in enumerate(left)])
        length = int(last.min()) + 1
        used = np.array([length // size * int(q[i]) + int(np.searchsorted(slots[i], length % size)) for i in range(len(active))])
        out.append({"active": active, "q": q, "slots": slots, "size": size, "done": done.copy(), "start": start, "length": length})
        done[active] += used
        start += length
    return out


def slot_of(plan: list[dict], source: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and phase of each (source index, block index)."""
    slot, phase = np.full(len(source), -1, np.int64), np.full(len(source), -1, np.int64)
    order = np.argsort(source, kind="stable")
    names, first = np.unique(source[order], return_index=True)
    for s, rows in zip(names.tolist(), np.split(order, first[1:]) if len(order) else (), strict=True):
        # a source takes part in phases from the first on, without a gap
        begins = np.array([p["done"][s] for p in plan if s in p["active"]])
        n = np.searchsorted(begins, block[rows], "right") - 1
        for k in np.unique(n).tolist():
            p, at = plan[k], rows[n == k]
            i = int(np.searchsorted(p["active"], s))
            inside = block[at] - p["done"][s]
            slot[at] = p["start"] + inside // int(p["q"][i]) * p["size"] + p["slots"][i][inside % int(p["q"][i])]
            phase[at] = k
    return slot, phase


_PLACED = "doc_id long, tie long, source string, chars long, part int, inside long"


def _running(batches):
    """Rows of a range, sorted by source: inside is the text volume of the source's rows before, in this range."""
    from pyspark import TaskContext

    part, at, total = TaskContext.get().partitionId(), (False, None), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code = pa.compute.fill_null(batch.column("source").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        chars = batch.column("chars").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        before = np.cumsum(chars) - chars
        inside = before - np.repeat(before[first], np.diff(np.append(first, len(code))))
        if at == (True, batch.column("source")[0].as_py()):
            inside[: first[1] if len(first) > 1 else len(code)] += total
        at, total = (True, batch.column("source")[-1].as_py()), int(inside[-1] + chars[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tie", "source", "chars")), pa.array(np.full(len(code), part, np.int32)), pa.array(inside)], ["doc_id", "tie", "source", "chars", "part", "inside"])


def source_positions(docs: DataFrame, tables: Tables, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, tie, source, chars, before): before is the text volume of the same source's earlier documents."""
    chars = F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0)).alias("chars")
    tie = (F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")).alias("tie")
    rows = tables.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie, F.col("source").cast("string").alias("source"), chars), "rows")
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // range_rows))
    order = ("source", "doc_id", "tie", "chars", "at")
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("at")
    rows = tables.keep(dealt.mapInArrow(_running, _PLACED), "ranges")
    total = rows.groupBy("source", "part").agg(F.sum("chars").alias("sum"))  # as many rows as ranges and sources together at most
    before = total.withColumn("offset", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("s"), F.col("part").alias("p"), "offset")
    placed = rows.join(tables.keep(before, "offsets"), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return placed.select("doc_id", "tie", "source", "chars", (F.col("offset") + F.col("inside")).alias("before"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, tie, source, block, slot, phase.

    weights: target weights by source; by default the square root of each
    source's text volume.  A source without a positive weight gets the least.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "mixing")
    placed = tables.keep(source_positions(docs, tables, range_rows).withColumn("block", F.expr(f"before div {block_chars}")), "placed")
    stats = sorted(placed.groupBy("source").agg(F.max("block").alias("last"), F.sum("chars").alias("chars")).collect(), key=lambda r: (r.source is not None, r.source or ""))  # a row per source
    names = [r.source for r in stats]
    volume = np.array([max(1, r.chars) for r in stats], float)
    target = volume**EXPONENT if weights is None else np.array([float(weights.get(x, 0)) for x in names])
    shared = spark.sparkContext.broadcast(({x: i for i, x in enumerate(names)}, phases(np.array([r["last"] + 1 for r in stats], np.int64), target, period)))

    def place(batches):
        index, plan = shared.value
        for batch in batches:
            source = np.array([index[x] for x in batch.column("source").to_pylist()], np.int64)
            slot, phase = slot_of(plan, source, batch.column("block").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tie", "source", "block")), pa.array(slot), pa.array(phase)], ["doc_id", "tie", "source", "block", "slot", "phase"])

    return placed.select("doc_id", "tie", "source", "block").mapInArrow(place, "doc_id long, tie long, source string, block long, slot long, phase long")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mix_sources(docs).select("doc_id", "source", "block", "slot", "phase")
