"""Time alignment: nearest, bracketing and bounded matches of targets with frames.

Rows meet by key and time bucket; what lies beyond a bucket is carried by one
summary row for each key and bucket, so a hot key is spread over its buckets
and no side is broadcast.  Of frames with equal times the one with the smallest
tie value (a number) counts (scan order); of two equally near frames the earlier
one.  Targets without a time or key stay, with nothing found; such frames are
never found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def ns(ts: str | Column) -> Column:
    """Nanoseconds since the epoch of a timestamp without zone, in UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) * 1000


def _filled(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names))


def bracket(targets: DataFrame, frames: DataFrame, keys: list[str], at: str, ts: str, tie: str, payload: list[str], bucket_ns: int = DAY_NS) -> DataFrame:
    """targets with before (last frame at or before `at`) and after (first at or after): structs (ts, tie, payload...), null where there is none."""
    if not keys or bucket_ns <= 0:
        raise ValueError("keys must be given and bucket_ns positive")
    record = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), *(F.col(c).alias(c) for c in payload))
    here = frames.where(_filled([*keys, ts])).select(*keys, F.col(ts).alias("_at"), F.col(tie).alias("_tie"), record.alias("_frame"))
    wanted = targets.where(_filled([*keys, at])).select(*keys, F.col(at).alias("_at"), F.struct(*targets.columns).alias("_target"))
    rows = here.unionByName(wanted, allowMissingColumns=True).withColumn("_bucket", F.expr(f"_at div {bucket_ns}"))
    group = [*keys, "_bucket"]
    # one order serves all: frames of a time by tie, then targets of that time
    rows = rows.withColumn("_kind", F.col("_target").isNotNull().cast("int"))
    order = Window.partitionBy(*group).orderBy("_at", "_kind", "_tie")
    first = F.coalesce(F.lag("_at").over(order) != F.col("_at"), F.lit(True))
    heads = rows.withColumn("_head", F.when(first, F.col("_frame")))
    over = f"(PARTITION BY {', '.join(f'`{g}`' for g in group)} ORDER BY _at, _kind, _tie)"
    near = heads.withColumn("_before", F.last("_head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.expr(f"lead(_head) IGNORE NULLS OVER {over}")).where("_kind = 1")
    ends = rows.where("_kind = 0").groupBy(*group).agg(F.max_by("_frame", F.struct("_at", (-F.col("_tie")).alias("t"))).alias("_high"), F.min_by("_frame", F.struct("_at", "_tie")).alias("_low"))
    # buckets without a frame carry on what their neighbours hold
    places = near.select(*group).distinct().join(ends, group, "full")
    line = Window.partitionBy(*keys).orderBy("_bucket")
    line_back = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc())
    carried = places.select(*group, F.last("_high", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.last("_low", ignorenulls=True).over(line_back.rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    before = F.coalesce("_before", "_earlier")
    after = F.when(F.col("_before.ts") == F.col("_at"), F.col("_before")).otherwise(F.coalesce("_next", "_later"))
    found = near.join(carried, group).select("_target.*", before.alias("before"), after.alias("after"))
    none = F.lit(None).cast(found.schema["before"].dataType)
    return found.unionByName(targets.where(~_filled([*keys, at])).withColumns({"before": none, "after": none}))


def closest(before: Column, after: Column, at: Column) -> Column:
    """The nearer of two neighbours, the earlier one if both are equally near."""
    return F.when(after.isNull() | (at - before["ts"] <= after["ts"] - at), before).otherwise(after)


def nearest(targets: DataFrame, frames: DataFrame, keys: list[str], at: str, ts: str, tie: str, payload: list[str], bucket_ns: int = DAY_NS) -> DataFrame:
    """targets with nearest, a struct as in bracket(), and diff_ns."""
    both = bracket(targets, frames, keys, at, ts, tie, payload, bucket_ns)
    found = both.withColumn("nearest", closest(F.col("before"), F.col("after"), F.col(at)))
    return found.withColumn("diff_ns", F.abs(F.col("nearest.ts") - F.col(at))).drop("before", "after")


def within(found: Column, at: Column, window_ns: int | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """A neighbour, if it lies in the search window around `at` and in the closed bounds [start, end] (null bounds don't bound)."""
    ok = F.lit(True)
    if window_ns is not None:
        if window_ns < 0:
            raise ValueError("window_ns must not be negative")
        ok = ok & (F.abs(found["ts"] - at) <= window_ns)
    if start is not None:
        ok = ok & F.coalesce(found["ts"] >= start, F.lit(True))
    if end is not None:
        ok = ok & F.coalesce(found["ts"] <= end, F.lit(True))
    return F.when(ok, found)


def resolve(before: Column, after: Column, at: Column, tolerance_ns: int | Column) -> Column:
    """struct(strategy, ratio): nearest within the tolerance, else clamp to a lone neighbour, a single value, or interpolation."""
    b, a = at - before, after - at
    near = F.least(b, a)  # least skips nulls
    kind = F.when(near <= tolerance_ns, "nearest").when(before.isNull() & after.isNull(), "single_value").when(before.isNull(), "clamp_first").when(after.isNull(), "clamp_last").when(before == after, "single_value").otherwise("interpolated")
    return F.struct(kind.alias("strategy"), F.when(kind == "interpolated", b.cast("double") / (after - before).cast("double")).alias("ratio"))


def lerp(a: Column, b: Column, ratio: Column) -> Column:
    return a + (b - a) * ratio


def merge_brackets(*results: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets of several scans of the same targets, as of one scan: the latest before and the earliest after."""
    every = reduce(DataFrame.unionByName, results)
    return every.groupBy(*keys).agg(F.max_by("before", "before.ts").alias("before"), F.min_by("after", "after.ts").alias("after"))


def scan_window(messages: DataFrame, topic: str, topics: list[str], ts: str, start: int, end: int) -> DataFrame:
    """Messages of some topics in [start, end); both predicates reach the scan."""
    if start >= end:
        raise ValueError("start must be before end")
    return messages.where(F.col(topic).isin(topics) & (F.col(ts) >= start) & (F.col(ts) < end))


def prune_sources(sources: DataFrame, start: int, end: int) -> DataFrame:
    """Sources (start_ns, end_ns) that may hold messages of [start, end); unknown ranges stay."""
    return sources.where((F.col("end_ns").isNull() | (F.col("end_ns") >= start)) & (F.col("start_ns").isNull() | (F.col("start_ns") < end)))


def resolve_episode(index: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """wanted with n_matches and, where it is 1, the episode; bounds match exactly."""
    hits = wanted.join(index, on, "left").groupBy(*on).agg(F.count("episode_id").alias("n_matches"), F.min("episode_id").alias("_episode"))
    return hits.select(*on, "n_matches", F.when(F.col("n_matches") == 1, F.col("_episode")).alias("episode_id"))


def parent_segment(segments: DataFrame, task: str, sequence: str, level: str, start: str, end: str) -> DataFrame:
    """segments with parent_start and parent_end: bounds of the only level-1 segment of the task with the same sequence, null if there isn't exactly one."""
    tops = segments.where(F.col(level) == 1).groupBy(task, sequence).agg(F.count("*").alias("_n"), F.min(start).alias("_s"), F.min(end).alias("_e")).where("_n = 1")
    return segments.join(tops.select(task, sequence, F.col("_s").alias("parent_start"), F.col("_e").alias("parent_end")), [task, sequence], "left")


def first_match(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by order; rows without a key go."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return first.select("_row.*")


def main_frame_bounds(episodes: DataFrame, main: DataFrame, keys: list[str], start: str, end: str, ts: str, tie: str) -> DataFrame:
    """episodes with t0_ns and last_main_ns: the first and last main-camera frame in the closed range [start, end], null where there is none."""
    first = bracket(episodes, main, keys, start, ts, tie, []).withColumn("t0_ns", F.when(F.col("after.ts") <= F.col(end), F.col("after.ts"))).drop("before", "after")
    both = bracket(first, main, keys, end, ts, tie, [])
    return both.withColumn("last_main_ns", F.when(F.col("before.ts") >= F.col(start), F.col("before.ts"))).drop("before", "after")


def contained(spans: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, bucket_ns: int = DAY_NS) -> DataFrame:
    """spans with inside: the number of points of the same keys in the closed range [start, end]; 0 where a bound is null.

    Each span takes two ranks, among points up to its end and before its
    start, so no span meets its points; sums of buckets carry the ranks on.
    """
    base = spans.withColumn("_id", F.struct(*keys, start, end))
    edge = lambda c, kind: spans.where(_filled([*keys, start, end])).select(*keys, F.col(c).alias("_at"), F.lit(kind).alias("_kind"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    marks = points.where(_filled([*keys, at])).select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_e"))
    rows = marks.unionByName(edge(start, 0)).unionByName(edge(end, 2)).withColumn("_bucket", F.expr(f"_at div {bucket_ns}"))
    group = [*keys, "_bucket"]
    rank = F.count(F.when(F.col("_kind") == 1, 1)).over(Window.partitionBy(*group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    own = rows.withColumn("_rank", rank).where("_kind <> 1")
    sums = rows.groupBy(*group).agg(F.count(F.when(F.col("_kind") == 1, 1)).alias("_n"))
    before = sums.select(*group, F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranks = own.join(before, group).select(*keys, "_s", "_e", "_kind", (F.col("_rank") + F.col("_base")).alias("_rank"))
    counts = ranks.groupBy(*keys, "_s", "_e").agg((F.max(F.when(F.col("_kind") == 2, F.col("_rank"))) - F.max(F.when(F.col("_kind") == 0, F.col("_rank")))).alias("_inside"))
    counts = counts.select(F.struct(*keys, F.col("_s").alias(start), F.col("_e").alias(end)).alias("_id"), "_inside")
    return base.join(counts, "_id", "left").select(*spans.columns, F.greatest(F.coalesce("_inside", F.lit(0)), F.lit(0)).alias("inside"))
