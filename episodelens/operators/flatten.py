"""Nested results of labelling and playback services as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ns_seconds

_START = ("startTimeNs", "startTimestampNs", "start_time_ns", "start_timestamp_ns")
_END = ("endTimeNs", "endTimestampNs", "end_time_ns", "end_timestamp_ns")
_SUBTASKS = ("sub_tasks_annotation", "subtasks_annotation", "sub_tasks", "subtasks", "sub_task_annotation")


def get_text(v: Column, *paths: str) -> Column:
    """The first of some paths of a VARIANT that is neither null nor ''."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{p}", "string"), F.lit("")) for p in paths))


def get_list(v: Column, *paths: str) -> Column:
    """The first of some paths of a VARIANT that is a list."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{p}", "array<variant>") for p in paths))


def playback(body: Column, camera_key: str | None = None) -> Column:
    """struct(camera_key, topic, start_ns, end_ns) of a playback document: a whole one, or one composed of a camera (the wanted one, else the first) and a timeline; null without both."""
    ready = [F.when(get_text(F.try_variant_get(body, p, "variant"), "baseline_start_time_ns").isNotNull(), F.try_variant_get(body, p, "variant")) for p in ("$.playback", "$.annotation.playback", "$")]
    whole = F.coalesce(*ready)
    cameras = get_list(body, "cameras")
    wanted = F.get(F.filter(cameras, lambda c: get_text(c, "camera_key") == camera_key), F.lit(0)) if camera_key else F.lit(None).cast("variant")
    camera = F.coalesce(wanted, F.get(cameras, F.lit(0)))
    timeline = F.try_variant_get(body, "$.timeline", "variant")
    start = F.coalesce(get_text(camera, "segments[0].global_start_time_ns"), get_text(timeline, "start_time_ns"))
    end = F.coalesce(get_text(camera, "segments[0].global_end_time_ns"), get_text(timeline, "end_time_ns"))
    make = lambda key, topic, a, b: F.struct(key.alias("camera_key"), topic.alias("topic"), a.try_cast("bigint").alias("start_ns"), b.try_cast("bigint").alias("end_ns"))
    composed = F.when(get_text(camera, "camera_key").isNotNull() & start.isNotNull() & end.isNotNull(), make(get_text(camera, "camera_key"), get_text(camera, "segments[0].image_topic", "segments[0].topic"), start, end))
    return F.when(whole.isNotNull(), make(get_text(whole, "baseline_camera_key"), get_text(whole, "topic"), get_text(whole, "baseline_start_time_ns"), get_text(whole, "baseline_end_time_ns"))).otherwise(composed)


def _segments(rows: DataFrame, key: str, category: str, layer: str) -> DataFrame:
    """Segments of (key, _job, _base, _at, _item); items without bounds go."""
    item = F.col("_item")
    offset = lambda *p: F.col("_base") + F.bround(get_text(item, *p).try_cast("double") * 1e9).cast("long")
    start, end = get_text(item, *_START).try_cast("bigint"), get_text(item, *_END).try_cast("bigint")
    timed = F.when(get_text(item, *_START).isNotNull() & get_text(item, *_END).isNotNull(), F.struct(start.alias("s"), end.alias("e"))).otherwise(F.struct(offset("startSec", "start_sec").alias("s"), offset("endSec", "end_sec").alias("e")))
    name = get_text(item, "description", "prompt", "name", "label", "text")
    found = rows.withColumn("_t", timed).where("_t.s is not null and _t.e is not null")
    ident = F.coalesce(get_text(item, "segmentId", "segment_id", "id"), F.concat_ws(":", F.lit("auto"), "_job", F.lit(category), F.col("_at").cast("string")))
    relative = lambda c: F.col(c) - F.col("_base")
    problem = F.when(F.col("_t.e") < F.col("_t.s"), "ends before it starts").when(name.isNull(), "no description")
    return found.select(key, F.lit(category).alias("category"), ident.alias("id"), F.coalesce(get_text(item, "layerId", "layer_id"), F.lit(layer)).alias("layer_id"), name.alias("description"), F.coalesce(get_text(item, "prompt"), name).alias("prompt"), F.coalesce(get_text(item, "source"), F.lit("auto")).alias("source"), F.col("_t.s").alias("start_ns"), F.col("_t.e").alias("end_ns"), relative("_t.s").alias("relative_start_ns"), relative("_t.e").alias("relative_end_ns"), ns_seconds(F.col("_t.s")).alias("start_time"), ns_seconds(F.col("_t.e")).alias("end_time"), problem.alias("problem"))


def auto_segments(results: DataFrame, key: str, result: str, job: str, base_ns: str) -> DataFrame:
    """Segments of labelling results (VARIANT): episodes with their sub-tasks, else sub-tasks beside the episodes; seconds count from base_ns, missing ids are made of job, category and place."""
    body = lambda c: F.coalesce(F.try_variant_get(c, "$.segment", "variant"), c)
    own = results.select(F.col(key), F.col(job).cast("string").alias("_job"), F.col(base_ns).alias("_base"), F.col(result).alias("_r"))
    episodes = own.select(key, "_job", "_base", F.posexplode(get_list(F.col("_r"), "episodes_annotation")).alias("_at", "_e"))
    tops = _segments(episodes.withColumn("_item", body(F.col("_e"))), key, "episode", "l1")
    nested = F.coalesce(get_list(F.col("_e"), *_SUBTASKS), get_list(body(F.col("_e")), *_SUBTASKS[:4]))
    inner = episodes.select(key, "_job", "_base", F.posexplode(nested).alias("_at", "_s"))
    subs = _segments(inner.withColumn("_item", body(F.col("_s"))), key, "sub_task", "l2")
    beside = own.where(F.size(get_list(F.col("_r"), "episodes_annotation")) > 0).join(subs.select(key).distinct(), key, "left_anti").select(key, "_job", "_base", F.posexplode(get_list(F.col("_r"), *_SUBTASKS[:2])).alias("_at", "_s"))
    return tops.unionByName(subs).unionByName(_segments(beside.withColumn("_item", body(F.col("_s"))), key, "sub_task", "l2"))


def time_fields(segments: DataFrame, start: str, end: str, base: str) -> DataFrame:
    """segments with relative bounds in ns, and bounds and relative bounds as text of seconds with nine digits."""
    out = segments.withColumns({"relative_start_ns": F.col(start) - F.col(base), "relative_end_ns": F.col(end) - F.col(base)})
    return out.withColumns({name: ns_seconds(F.col(c)) for name, c in (("start_time", start), ("end_time", end), ("relative_start_time", "relative_start_ns"), ("relative_end_time", "relative_end_ns"))})


def last_reversed(values: Column, n: int = 2) -> Column:
    """The last n elements, last one first; null if there are fewer, or one is blank."""
    tail = F.reverse(F.slice(values, -n, n))
    return F.when((F.size(values) >= n) & F.forall(tail, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), tail)


def identify(rows: DataFrame, name: str, prefix: str, base_ms: int) -> DataFrame:
    """rows with distinct ids: a prefix and milliseconds from base_ms on; they ascend within a partition, and differ from run to run of another layout."""
    return rows.withColumn(name, F.concat(F.lit(prefix), (F.lit(base_ms) + F.monotonically_increasing_id()).cast("string")))
