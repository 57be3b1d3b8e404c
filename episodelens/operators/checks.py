"""Frame-table checks.  Each returns violations: check, entity, row_index, expected, actual (text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FPS, GRID_S, ORIGIN_NS, START_S = 30, 2e-5, 1000, 1e-9


def violations(rows: DataFrame, check: str, bad: Column, entity: str, row: str, expected: Column, actual: Column) -> DataFrame:
    return rows.where(bad).select(F.lit(check).alias("check"), F.col(f"`{entity}`").cast("string").alias("entity"), F.col(row).cast("long").alias("row_index"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def exploded(rows: DataFrame, entity: str, row: str, checks: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Violations of many checks (name, bad, expected, actual) in one pass over rows; a null verdict is no violation."""
    found = F.array(*(F.when(bad, F.struct(F.lit(name).alias("check"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))) for name, bad, expected, actual in checks))
    each = rows.select(F.col(f"`{entity}`").cast("string").alias("entity"), F.col(f"`{row}`").cast("long").alias("row_index"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v"))
    return each.select("v.check", "entity", "row_index", "v.expected", "v.actual")


def increasing(rows: DataFrame, entity: str, row: str, value: str) -> DataFrame:
    """Values that don't exceed the last non-null one before."""
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(entity).orderBy(row).rowsBetween(Window.unboundedPreceding, -1))
    return violations(rows.withColumn("_p", before), "increasing", F.col(value) <= F.col("_p"), entity, row, F.concat(F.lit(">"), F.col("_p").cast("string")), F.col(value))


def continuous(rows: DataFrame, entity: str, row: str, value: str) -> DataFrame:
    """Values other than the row's position in its entity; row gives the physical order."""
    place = F.row_number().over(Window.partitionBy(entity).orderBy(row)) - 1
    return violations(rows.withColumn("_k", place), "continuous", ~F.col(value).eqNullSafe(F.col("_k")), entity, row, F.col("_k"), F.col(value))


def progress(rows: DataFrame, entity: str, row: str, value: str, part: str | None = None) -> DataFrame:
    """Values that are null, outside [0, 1] or below the last non-null one before, in one part of the entity."""
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(entity, *([part] if part else [])).orderBy(row).rowsBetween(Window.unboundedPreceding, -1))
    v = F.col(value)
    return violations(rows.withColumn("_p", before), "progress", v.isNull() | (v < 0) | (v > 1) | (v < F.col("_p")), entity, row, F.lit("non-decreasing in [0,1]"), v)


def done_flags(rows: DataFrame, entity: str, row: str, value: str) -> DataFrame:
    """Flags that aren't true on the last row of their entity and false before; null is a violation."""
    last = F.max(row).over(Window.partitionBy(entity))
    want = F.col(row) == last
    return violations(rows.withColumn("_w", want), "done", ~F.col(value).eqNullSafe(F.col("_w")), entity, row, F.col("_w"), F.col(value))


def levels_increase(levels: Column) -> Column:
    """Does each element exceed the one before?"""
    return F.forall(F.sequence(F.lit(0), F.greatest(F.size(levels) - 2, F.lit(0))), lambda i: F.coalesce(F.get(levels, i + 1) > F.get(levels, i), F.size(levels) < 2))


def fixed_grid(rows: DataFrame, entity: str, row: str, seconds: str, origin_ns: str, start_ns: str, fps: int = FPS) -> DataFrame:
    """Frames off the grid n / fps: in seconds, or in nanoseconds from start_ns (rounded half to even)."""
    n = F.row_number().over(Window.partitionBy(entity).orderBy(row)) - 1
    rows = rows.withColumn("_n", n).withColumn("_s", F.col("_n") / F.lit(float(fps))).withColumn("_o", F.col(start_ns) + F.bround(F.col("_n") * 1e9 / fps).cast("long"))
    a = violations(rows, "grid_seconds", F.abs(F.col(seconds) - F.col("_s")) > F.when(F.col("_n") == 0, START_S).otherwise(GRID_S), entity, row, F.round("_s", 6), F.round(seconds, 6))
    return a.unionByName(violations(rows, "grid_origin", F.abs(F.col(origin_ns) - F.col("_o")) > ORIGIN_NS, entity, row, F.col("_o"), F.col(origin_ns)))


def frame_count(span_ns: Column, fps: int = FPS) -> Column:
    """Frames that fit a span of nanoseconds, both ends included; exact."""
    scaled, second = span_ns.cast("long") * fps, F.lit(10**9)
    return F.round((scaled - F.pmod(scaled, second)) / second).cast("long") + 1


def fixed_fps_audit(frames: DataFrame, main: DataFrame, episodes: DataFrame, keys: list[str], row: str, fps: int = FPS) -> DataFrame:
    """Violations of the fixed grid of each episode, from its first main-camera frame to the earlier of its end and the last one.

    frames: keys, row, timestamp (seconds), original_timestamp_ns, frame_index;
    main: keys, log_ns, seq; episodes: keys, start_ns, end_ns, one row each.
    Episodes without a main-camera frame or without rows are violations, and so
    are nulls in a required column.
    """
    from .align import main_frame_bounds

    entity = F.concat_ws("/", *keys)
    known = main_frame_bounds(episodes, main, keys, "start_ns", "end_ns", "log_ns", "seq")
    known = known.withColumn("_end", F.least("end_ns", "last_main_ns"))
    rows = frames.join(known.select(*keys, "t0_ns"), keys).withColumn("_entity", entity)
    order = Window.partitionBy(*keys).orderBy(row)
    ts, origin, index = F.col("timestamp"), F.col("original_timestamp_ns"), F.col("frame_index")
    n = F.row_number().over(order) - 1
    rows = rows.withColumn("_n", n).withColumn("_p", F.lag("original_timestamp_ns").over(order))
    due = F.col("t0_ns") + F.bround(F.col("_n") * 1e9 / fps).cast("long")
    first, second = F.col("_n") == 0, F.col("_n") / F.lit(float(fps))
    found = exploded(
        rows,
        "_entity",
        row,
        [
            ("required", ts.isNull() | origin.isNull() | index.isNull(), F.lit("values"), F.lit(None)),
            ("first_origin", first & (F.abs(origin - F.col("t0_ns")) > ORIGIN_NS), F.col("t0_ns"), origin),
            ("first_seconds", first & (F.abs(ts) > START_S), F.lit(0), F.round(ts, 6)),
            ("frame_index", index != F.col("_n"), F.col("_n"), index),
            ("grid_seconds", F.abs(ts - second) > GRID_S, F.round(second, 6), F.round(ts, 6)),
            ("grid_origin", F.abs(origin - due) > ORIGIN_NS, due, origin),
            ("increasing", origin <= F.col("_p"), F.concat(F.lit(">"), F.col("_p").cast("string")), origin),
        ],
    )
    counts = known.join(frames.groupBy(*keys).agg(F.count("*").alias("_rows")), keys, "left").withColumn("_entity", entity).withColumn("_none", F.lit(None).cast("long"))
    want, have = frame_count(F.col("_end") - F.col("t0_ns"), fps), F.coalesce("_rows", F.lit(0))
    return found.unionByName(exploded(counts, "_entity", "_none", [("main_camera", F.col("t0_ns").isNull() | F.col("last_main_ns").isNull(), F.lit("a frame"), F.lit(None)), ("frame_count", F.col("t0_ns").isNotNull() & (want != have), want, have)]))


def capped(found: DataFrame, entity: str, most: int = 100) -> DataFrame:
    """Per entity: the number of violations and the first `most` messages in row order."""
    rank = F.row_number().over(Window.partitionBy(entity).orderBy("row_index", "check"))
    message = F.when(F.col("_r") <= most, F.struct(F.col("_r").alias("r"), F.format_string("%s@%s", "check", F.col("row_index").cast("string")).alias("m")))
    out = found.withColumn("_r", rank).groupBy(entity).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(message)).alias("m"))
    return out.select(entity, "n", F.transform("m", lambda x: x["m"]).alias("messages"), F.greatest(F.col("n") - most, F.lit(0)).alias("overflow"))


def report(found: DataFrame, most: int = 100) -> DataFrame:
    """One row: consistent, the number of violations, and by check how many; the first `most` as failures, by entity, row and check."""
    by = found.groupBy("check").agg(F.count("*").alias("n"))
    counts = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", "n")))).alias("by_check"))
    first = found.orderBy("entity", "row_index", "check").limit(most)
    failures = first.agg(F.array_sort(F.collect_list(F.struct("entity", "row_index", "check", "expected", "actual"))).alias("failures"))
    both = counts.withColumn("_k", F.lit(1)).join(failures.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.select((F.col("violations") == 0).alias("consistent"), "violations", "by_check", "failures")


def missing_columns(df: DataFrame, required: list[str], strict: bool = False) -> list[str]:
    """Required columns that df lacks; an error, if strict."""
    lacking = [c for c in dict.fromkeys(required) if c not in df.columns]
    if strict and lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return lacking


def segments_within(segments: DataFrame, start: str, end: str, low: str, high: str) -> DataFrame:
    """segments with problem: what is wrong with their bounds against the task's range [low, high]; null if nothing is."""
    s, e = F.col(start), F.col(end)
    return segments.withColumn("problem", F.when(s.isNull() | e.isNull(), "no bounds").when(s >= e, "empty").when((s < F.col(low)) | (e > F.col(high)), "outside"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1")


def hierarchy(rows: DataFrame, entity: str, row: str, json: str = "annotation.hierarchy_json") -> DataFrame:
    """rows with levels: array of (level, layer_id, id, name, start_ns, end_ns) from the JSON, snake or camel keys; null for bad JSON, and null for elements that are no objects."""
    kind = ", ".join(f"{k} string" for k in ("level", "layer_id", "layerId", "id", "segmentId", "name", "description", "prompt", "start_timestamp_ns", "startTimeNs", "end_timestamp_ns", "endTimeNs"))
    fill = lambda x, *ks: F.coalesce(*(F.nullif(F.trim(x[k]), F.lit("")) for k in ks))
    items = F.from_json(F.col(f"`{json}`"), f"array<struct<{kind}>>")
    return rows.withColumn("levels", F.transform(items, lambda x: F.when(x.isNotNull(), F.struct(x["level"].try_cast("int").alias("level"), fill(x, "layer_id", "layerId").alias("layer_id"), fill(x, "id", "segmentId").alias("id"), fill(x, "name", "description", "prompt").alias("name"), fill(x, "start_timestamp_ns", "startTimeNs").try_cast("bigint").alias("start_ns"), fill(x, "end_timestamp_ns", "endTimeNs").try_cast("bigint").alias("end_ns")))))


def annotation_audit(frames: DataFrame, entity: str, row: str, levels: tuple[int, ...] = ()) -> DataFrame:
    """Audit of annotated frames (one entity: one file), in one pass: order, continuity, progress, done, hierarchy, flattened columns, path; and ids with several definitions.

    levels: those from 2 on whose flattened columns must agree with the
    hierarchy.  Columns that frames lack are violations without a row.
    """
    from ..functions.text import ordered_in

    text = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    df, here = hierarchy(frames, entity, row), set(frames.columns)
    order = Window.partitionBy(entity).orderBy(row)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_episode", F.coalesce(*(F.nullif(text(c), F.lit("")) for c in ("episode_id", "episode_index") if c in here), F.lit("")))
    df = df.withColumns({
        "_prior": F.last("original_timestamp_ns", ignorenulls=True).over(upto(order)),
        "_place": F.row_number().over(order) - 1,
        "_done": F.col(row) == F.max(row).over(Window.partitionBy(entity, "_episode")),
        "_progress": F.last("subtask_progress", ignorenulls=True).over(upto(Window.partitionBy(entity, text("subtask_id")).orderBy(row))),
    })
    some = F.filter("levels", lambda x: x.isNotNull())
    ok, now = F.coalesce(F.size("levels") > 0, F.lit(False)), F.col("original_timestamp_ns")
    first, last, names = F.get(some, F.lit(0)), F.element_at(some, -1), F.transform(some, lambda x: F.coalesce(x["name"], F.lit("")))
    any_of = lambda bad: ok & F.exists(some, lambda x: F.coalesce(bad(x), F.lit(False)))
    p = F.col("subtask_progress")
    checks = [
        ("timestamp", now.isNull(), F.lit("a number"), F.lit(None)),
        ("increasing", now <= F.col("_prior"), F.concat(F.lit(">"), F.col("_prior").cast("string")), now),
        ("frame_index", ~F.col("frame_index").eqNullSafe(F.col("_place")), F.col("_place"), F.col("frame_index")),
        ("index", ~F.col("index").eqNullSafe(F.col("_place")), F.col("_place"), F.col("index")),
        ("episode", F.col("_episode") == "", F.lit("an id or index"), F.lit("")),
        ("progress", p.isNull() | (p < 0) | (p > 1) | (p < F.col("_progress")), F.lit("non-decreasing in [0,1]"), p),
        ("done", ~F.col("done").eqNullSafe(F.col("_done")), F.col("_done"), F.col("done")),
        ("hierarchy", ~ok, F.lit("a list of levels"), F.col("`annotation.hierarchy_json`")),
        ("hierarchy_item", ok & F.exists("levels", lambda x: x.isNull()), F.lit("objects"), F.col("`annotation.hierarchy_json`")),
        ("level", any_of(lambda x: x["level"].isNull() | (x["level"] < 1)), F.lit("a positive level"), F.to_json(F.transform(some, lambda x: x["level"]))),
        ("layer_id", any_of(lambda x: (x["level"] >= 1) & ~x["layer_id"].eqNullSafe(F.concat(F.lit("l"), x["level"].cast("string")))), F.lit("l and the level"), F.to_json(F.transform(some, lambda x: x["layer_id"]))),
        ("id", any_of(lambda x: x["id"].isNull()), F.lit("an id"), F.to_json(F.transform(some, lambda x: x["id"]))),
        ("name", any_of(lambda x: x["name"].isNull()), F.lit("a name"), F.to_json(names)),
        ("interval", any_of(lambda x: x["start_ns"].isNull() | x["end_ns"].isNull() | (x["start_ns"] >= x["end_ns"])), F.lit("start before end"), F.to_json(some)),
        ("containment", any_of(lambda x: (x["start_ns"] < x["end_ns"]) & ((now < x["start_ns"]) | (now > x["end_ns"]))), F.lit("within bounds"), now),
        ("levels", ok & ~levels_increase(F.transform(some, lambda x: x["level"])), F.lit("increasing"), F.to_json(F.transform(some, lambda x: x["level"]))),
        ("path", ok & ~(ordered_in(text("annotation.path"), names) & ~F.array_contains(names, "")), F.array_join(names, " > "), F.col("`annotation.path`") if "annotation.path" in here else F.lit(None)),
    ]
    flat = [("task", first["name"]), ("subtask", last["name"]), ("subtask_id", last["id"]), ("annotation.level_1_id", first["id"]), ("annotation.level_1_name", first["name"]), ("annotation.leaf_id", last["id"]), ("annotation.leaf_name", last["name"])]
    for level in levels:
        own = F.get(F.filter(some, lambda x, level=level: x["level"] == level), F.lit(0))
        flat += [(f"annotation.level_{level}_id", own["id"]), (f"annotation.level_{level}_name", own["name"])] if level > 1 else []
    for column, want in flat:
        if column in here:
            checks.append((column, ok & (text(column) != F.coalesce(want, F.lit(""))), want, F.col(f"`{column}`")))
    required = ["original_timestamp_ns", "frame_index", "index", "done", "subtask_progress", "annotation.hierarchy_json", "annotation.path", *(c for c, _ in flat)]
    lacking = missing_columns(frames, required)
    checks = [c for c in checks if c[0] != "path" or "annotation.path" in here]
    out = exploded(df, entity, row, checks)
    each = df.select(entity, F.explode(some).alias("l")).where("l.id is not null").groupBy(entity, "l.level", "l.layer_id", "l.id").agg(F.count_distinct(F.struct("l.name", "l.start_ns", "l.end_ns")).alias("_n")).withColumn("_none", F.lit(None).cast("long"))
    out = out.unionByName(exploded(each, entity, "_none", [("definitions", F.col("_n") > 1, F.lit(1), F.concat_ws(": ", "id", F.col("_n").cast("string")))]))
    if lacking:
        names_of = frames.select(F.col(entity).cast("string").alias("entity")).distinct().select(F.explode(F.array(*map(F.lit, lacking))).alias("c"), "entity")
        out = out.unionByName(names_of.select(F.lit("missing_column").alias("check"), "entity", F.lit(None).cast("long").alias("row_index"), F.col("c").alias("expected"), F.lit(None).cast("string").alias("actual")))
    return out


def annotation_summary(frames: DataFrame, entity: str, row: str) -> DataFrame:
    """Per entity and annotation: frames, first and last row and time, and (with a column timestamp) the least and greatest playback time."""
    played = F.col("timestamp").cast("double") if "timestamp" in frames.columns else F.lit(None).cast("double")
    each = hierarchy(frames, entity, row).withColumn("_played", played).select(entity, row, "original_timestamp_ns", "_played", F.explode("levels").alias("l")).where("l is not null").select(entity, row, "original_timestamp_ns", "_played", "l.*")
    return summarize(each, [entity, "level", "layer_id", "id", "name", "start_ns", "end_ns"], row, "original_timestamp_ns", "_played")


def summarize(rows: DataFrame, keys: list[str], row: str, ts: str, played: str | None = None) -> DataFrame:
    """Per key: row_count, first_row, last_row, the times of these rows, and first and last playback."""
    p = F.col(played) if played else F.lit(None).cast("double")
    return rows.groupBy(*keys).agg(F.count("*").alias("row_count"), F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.min_by(ts, row).alias("first_timestamp"), F.max_by(ts, row).alias("last_timestamp"), F.min(p).alias("first_playback"), F.max(p).alias("last_playback"))


def ordered_annotations(summary: DataFrame) -> DataFrame:
    """Annotations by level (null last), start (null first) and id."""
    return summary.orderBy(F.coalesce("level", F.lit(999)), F.coalesce("start_ns", F.lit(-1)), "id")


def expected_layers(rows: DataFrame, key: list[str], json: str) -> DataFrame:
    """key, level, layer_id, ord, id, name, start_ns, end_ns of submitted layers: a layer l<n> has level n, another one its place."""
    segment = ", ".join(f"{k} string" for k in ("segmentId", "id", "description", "prompt", "name", "startTimeNs", "startTimestampNs", "endTimeNs", "endTimestampNs"))
    layers = rows.select(*key, F.posexplode(F.from_json(F.col(f"`{json}`"), f"array<struct<layerId string, layer_id string, segments array<struct<{segment}>>>>")).alias("_at", "_layer"))
    fill = lambda x, *ks: F.coalesce(*(F.nullif(F.trim(x[k]), F.lit("")) for k in ks))
    layer = F.coalesce(fill(F.col("_layer"), "layerId", "layer_id"), F.lit(""))
    level = F.coalesce(F.nullif(F.regexp_extract(F.lower(layer), r"^l(\d+)$", 1), F.lit("")).cast("int"), F.col("_at") + 1)
    each = layers.select(*key, level.alias("level"), F.when(layer == "", F.concat(F.lit("l"), level.cast("string"))).otherwise(layer).alias("layer_id"), F.explode("_layer.segments").alias("s"))
    found = each.select(*key, "level", "layer_id", F.coalesce(fill(F.col("s"), "segmentId", "id"), F.lit("")).alias("id"), F.coalesce(fill(F.col("s"), "description", "prompt", "name"), F.lit("")).alias("name"), fill(F.col("s"), "startTimeNs", "startTimestampNs").try_cast("bigint").alias("start_ns"), fill(F.col("s"), "endTimeNs", "endTimestampNs").try_cast("bigint").alias("end_ns"))
    return found.withColumn("ord", F.row_number().over(Window.partitionBy(*key).orderBy("level", F.coalesce("start_ns", F.lit(-1)), "id")) - 1)


def first_top(json: Column) -> Column:
    """struct(id, name, start_ns, end_ns) of the first level-1 element of a hierarchy; null without one whose bounds are numbers."""
    kind = ", ".join(f"{k} string" for k in ("level", "id", "segmentId", "name", "description", "prompt", "start_timestamp_ns", "startTimeNs", "end_timestamp_ns", "endTimeNs"))
    fill = lambda x, *ks: F.coalesce(*(F.nullif(F.trim(x[k]), F.lit("")) for k in ks), F.lit(""))
    top = F.get(F.filter(F.from_json(json, f"array<struct<{kind}>>"), lambda x: x["level"].try_cast("int") == 1), F.lit(0))
    start, end = F.coalesce(top["start_timestamp_ns"], top["startTimeNs"]).try_cast("bigint"), F.coalesce(top["end_timestamp_ns"], top["endTimeNs"]).try_cast("bigint")
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(fill(top, "id", "segmentId").alias("id"), fill(top, "name", "description", "prompt").alias("name"), start.alias("start_ns"), end.alias("end_ns")))


def episode_index(frames: DataFrame, file: str, json: str = "annotation.hierarchy_json") -> DataFrame:
    """One row for each file: episode_id, episode_index, l1_id, l1_name, l1_start_ns, l1_end_ns, and problem: why it can't be one episode (null if it can)."""
    missing_columns(frames, ["episode_id", "episode_index", json], strict=True)
    ident = F.trim(F.coalesce(F.col("episode_id").cast("string"), F.lit("")))
    index = F.col("episode_index").cast("string").try_cast("bigint")
    rows = frames.select(file, ident.alias("_id"), index.alias("_index"), first_top(F.col(f"`{json}`")).alias("_top"))
    found = rows.groupBy(file).agg(
        F.count_distinct(F.struct("_id", "_index")).alias("_ids"), F.min(F.struct("_id", "_index")).alias("_e"), F.count_distinct("_top").alias("_tops"), F.min("_top").alias("_t"), F.bool_or(F.col("_id") == "").alias("_blank"), F.bool_or(F.col("_index").isNull()).alias("_bad")
    )
    problem = F.when(F.col("_bad"), "bad episode_index").when(F.col("_blank"), "blank episode_id").when(F.col("_ids") > 1, "several episodes").when(F.col("_tops") == 0, "no level 1").when(F.col("_tops") > 1, "several level 1")
    return found.select(file, F.col("_e._id").alias("episode_id"), F.col("_e._index").alias("episode_index"), F.col("_t.id").alias("l1_id"), F.col("_t.name").alias("l1_name"), F.col("_t.start_ns").alias("l1_start_ns"), F.col("_t.end_ns").alias("l1_end_ns"), problem.alias("problem"))
