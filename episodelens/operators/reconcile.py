"""Expected against actual: tables, annotations, vectors, listings."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds by which a playback may differ from the annotated duration.
PLAYBACK_S = 0.07


def full_outer(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys with state: missing, unexpected, different or equal; e_ and a_ values."""
    e = expected.select(*keys, *(F.col(v).alias(f"e_{v}") for v in values), F.lit(True).alias("_e"))
    a = actual.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(True).alias("_a"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"e_{v}").eqNullSafe(F.col(f"a_{v}"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(same, "equal").otherwise("different")
    return e.join(a, keys, "full").withColumn("state", state).drop("_e", "_a")


def vectors(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: float = 5e-4) -> DataFrame:
    """Long vectors (keys, label, value): differences as doubles; within: at most the tolerance; null where a side lacks the label."""
    e = expected.select(*keys, "label", F.col("value").cast("double").alias("expected"))
    a = actual.select(*keys, "label", F.col("value").cast("double").alias("actual"))
    out = e.join(a, [*keys, "label"], "full").withColumn("diff", F.abs(F.col("expected") - F.col("actual")))
    return out.withColumn("within", F.col("diff") <= tolerance)


def set_differences(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("only_left", "only_right")) -> DataFrame:
    """(side, key): values of one side that the other lacks, once each; a null counts as a value."""
    one, two = left.select(key).distinct(), right.select(key).distinct()
    part = lambda a, b, name: a.exceptAll(b).select(F.lit(name).alias("side"), key)
    return part(one, two, names[0]).unionByName(part(two, one, names[1]))


def presence(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows' keys with state: with or without a row of others."""
    found = rows.select(*keys)
    return found.join(others.select(*keys).distinct(), keys, "left_semi").withColumn("state", F.lit("with")).unionByName(found.join(others, keys, "left_anti").withColumn("state", F.lit("without")))


_FIELDS = ("layer_id", "id", "name", "start_ns", "end_ns")


class _Pool:
    """Annotations not taken yet, found by id, by content and by both, each in order."""

    def __init__(self, rows: list[dict]):
        self.rows, self.free = rows, [True] * len(rows)
        self.by: dict[tuple, deque[int]] = {}
        for i, r in enumerate(rows):
            content = (r["name"], r["start_ns"], r["end_ns"])
            for key in (("id", r["id"]), ("content", content), ("both", r["id"], content), ("any",)):
                self.by.setdefault(key, deque()).append(i)

    def first(self, *key) -> int | None:
        queue = self.by.get(key, ())
        while queue and not self.free[queue[0]]:
            queue.popleft()
        return queue[0] if queue else None

    def take(self, want: dict) -> tuple[str, dict | None]:
        content = (want["name"], want["start_ns"], want["end_ns"])
        tries = [("id", ("both", want["id"], content)), ("id", ("id", want["id"]))] if want["id"] else []
        for rule, key in (*tries, ("content", ("content", content)), ("order", ("any",))):
            if (i := self.first(*key)) is not None:
                self.free[i] = False
                return rule, self.rows[i]
        return "missing", None


def match_annotations(expected: DataFrame, actual: DataFrame, task: str) -> DataFrame:
    """Greedy one-to-one match for each task and level, in the order of expected rows.

    An expected annotation takes, of those left: one of the same id (if it has
    one), of these one of the same name and times; else one of the same name
    and times; else the first.  Rows: (task, level, ord, id, name, start_ns,
    end_ns, and layer_id if both sides have it); a null id counts as ''.
    Result: ords and ids of both sides, matched by what, and the differing fields
    (no id is held against an expected annotation without one); what is left is
    unexpected.  The work is linear in a task's annotations of one level, which
    are a person's work and are held by one task.
    """
    fields = [f for f in _FIELDS if f != "layer_id" or ("layer_id" in expected.columns and "layer_id" in actual.columns)]
    names = [task, "level", "ord", *fields]
    rows = expected.select(*names, F.lit("e").alias("side")).unionByName(actual.select(*names, F.lit("a").alias("side")))
    rows = rows.withColumns({"id": F.coalesce("id", F.lit("")), "level": F.col("level").cast("int"), "ord": F.col("ord").cast("long")})

    def match(part: pa.Table) -> pa.Table:
        found = sorted(part.to_pylist(), key=lambda r: (r["ord"] is None, r["ord"] or 0, r["id"]))
        pool, out = _Pool([r for r in found if r["side"] == "a"]), []
        for want in (r for r in found if r["side"] == "e"):
            rule, got = pool.take(want)
            differ = [f for f in fields if got is not None and (f != "id" or want["id"]) and want[f] != got[f]]
            out.append((want[task], want["level"], want["ord"], want["id"], got and got["ord"], got and got["id"], rule, ",".join(differ)))
        out += [(r[task], r["level"], None, None, r["ord"], r["id"], "unexpected", "") for r, free in zip(pool.rows, pool.free, strict=True) if free]
        kinds = (part.schema.field(task).type, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = zip(*out, strict=True) if out else [()] * 8
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [task, "level", "expected_ord", "expected_id", "actual_ord", "actual_id", "matched", "differences"])

    kind = expected.schema[task].dataType.simpleString()
    return rows.groupBy(task, "level").applyInArrow(match, f"`{task}` {kind}, level int, expected_ord long, expected_id string, actual_ord long, actual_id string, matched string, differences string")


def playback_durations(matches: DataFrame, expected: DataFrame, actual: DataFrame, task: str, tolerance_s: float = PLAYBACK_S) -> DataFrame:
    """Level-1 matches with the annotated duration, the played one (first_playback and last_playback of actual, in seconds), their difference and whether it is within the tolerance; what can't be told isn't consistent."""
    pairs = matches.where("level = 1 and expected_ord is not null and actual_ord is not null").select(task, "expected_ord", "actual_ord", "expected_id")
    e = expected.where("level = 1").select(task, F.col("ord").alias("expected_ord"), (F.col("end_ns") - F.col("start_ns")).alias("expected_ns"))
    a = actual.where("level = 1").select(task, F.col("ord").alias("actual_ord"), "first_playback", "last_playback", (F.col("last_playback") - F.col("first_playback")).alias("played_s"))
    both = pairs.join(e, [task, "expected_ord"]).join(a, [task, "actual_ord"])
    both = both.withColumn("error_s", F.abs(F.col("expected_ns") / F.lit(1e9) - F.col("played_s")))
    return both.withColumn("consistent", F.coalesce(F.col("error_s") <= tolerance_s, F.lit(False)))


def level_counts(expected: DataFrame, actual: DataFrame, task: str, always: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(task, level, expected_count, actual_count, consistent) of all levels there are, and those of always."""
    some = expected.select(task, "level", F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(task, "level", F.lit(0).alias("e"), F.lit(1).alias("a")))
    zero = some.select(task).distinct().select(task, F.explode(F.array(*map(F.lit, always))).alias("level"), F.lit(0).alias("e"), F.lit(0).alias("a"))
    counts = some.unionByName(zero).groupBy(task, "level").agg(F.sum("e").alias("expected_count"), F.sum("a").alias("actual_count"))
    return counts.withColumn("consistent", F.col("expected_count") == F.col("actual_count"))


def within_hundredth(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Do totals agree within a tolerance (decimals, so that the bound itself passes)?"""
    return F.abs(a.cast("decimal(38,9)") - b.cast("decimal(38,9)")) <= F.lit(str(tolerance)).cast("decimal(10,9)")
