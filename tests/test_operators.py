import json
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episodelens import sinks
from episodelens.functions import rotation, text
from episodelens.operators import align, checks, flatten, image_audit, images, png, reconcile, vectors
from episodelens.sources import config as conf
from episodelens.sources import mcap, tables


def brackets(spark, targets, frames, bucket):
    t = spark.createDataFrame(targets, "k string, at long")
    f = spark.createDataFrame(frames, "k string, ts long, id long, v double")
    return align.bracket(t, f, ["k"], "at", "ts", "id", ["v"], bucket), t, f


@pytest.mark.parametrize("bucket", [5, 100])
def test_bracket_and_nearest_against_loops(spark, bucket):
    rng = np.random.default_rng(1)
    frames = [("ab"[i % 2], int(x), i, float(x)) for i, x in enumerate(rng.integers(0, 60, 40))]
    targets = [("ab"[i % 2], int(x)) for i, x in enumerate({*range(-3, 64, 3)})] + [("c", 5)]
    out, t, f = brackets(spark, targets, frames, bucket)
    for r in out.collect():
        own = [x for x in frames if x[0] == r.k]
        low = min((x for x in own if x[1] <= r.at), key=lambda x: (-x[1], x[2]), default=None)
        high = min((x for x in own if x[1] >= r.at), key=lambda x: (x[1], x[2]), default=None)
        assert (r.before and r.before.tie) == (low and low[2]) and (r.after and r.after.tie) == (high and high[2])
    for r in align.nearest(t, f, ["k"], "at", "ts", "id", ["v"], bucket).collect():
        own = [x for x in frames if x[0] == r.k]
        want = min(own, key=lambda x: (abs(x[1] - r.at), x[1], x[2]), default=None)
        assert (r.nearest and r.nearest.tie) == (want and want[2])


def test_strategies(spark):
    rows = spark.createDataFrame([(1, 99, 120, 100), (2, 50, 200, 100), (3, None, 200, 100), (4, 50, None, 100), (5, None, None, 100), (6, None, 101, 100)], "i int, b long, a long, t long")
    got = {r.i: (r.s.strategy, r.s.ratio) for r in rows.select("i", align.resolve(F.col("b"), F.col("a"), F.col("t"), 3).alias("s")).collect()}
    assert got == {1: ("nearest", None), 2: ("interpolated", 1 / 3), 3: ("clamp_first", None), 4: ("clamp_last", None), 5: ("single_value", None), 6: ("nearest", None)}


def test_source_pruning_and_episode_resolution(spark):
    s = spark.createDataFrame([("a", 0, 10), ("b", 10, 20), ("c", None, None), ("d", 20, 30)], "n string, start_ns long, end_ns long")
    assert {r.n for r in align.prune_sources(s, 10, 20).collect()} == {"a", "b", "c"}
    index = spark.createDataFrame([("x", 0, 9), ("y", 0, 9), ("z", 5, 6)], "episode_id string, s long, e long")
    wanted = spark.createDataFrame([(0, 9), (5, 6), (1, 2)], "s long, e long")
    got = {(r.s, r.e): (r.n_matches, r.episode_id) for r in align.resolve_episode(index, wanted, ["s", "e"]).collect()}
    assert got == {(0, 9): (2, None), (5, 6): (1, "z"), (1, 2): (0, None)}


def test_rotation(spark):
    h = math.sqrt(0.5)
    row = spark.range(1).select(rotation.slerp(F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))), F.array(*map(F.lit, (0.0, 0.0, -h, -h))), F.lit(0.5)).alias("q"), rotation.euler_zyx(F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))).alias("e"), rotation.normalize(F.array(*[F.lit(0.0)] * 4)).alias("z"), rotation.euler_zyx(F.array(F.lit(0.0), F.lit(h), F.lit(0.0), F.lit(h))).alias("up")).first()
    assert row.q == pytest.approx([0, 0, math.sin(math.pi / 8), math.cos(math.pi / 8)])
    assert tuple(row.e) == (0, 0, 0) and row.z is None and row.up.pitch == pytest.approx(math.pi / 2)


def test_text(spark):
    rows = spark.createDataFrame([("exact_frame",), ("",), ("2.5",), ("-1",), ("x",), (None,)], "p string")
    assert [r[0] for r in rows.select(text.tolerance_ns(F.col("p"))).collect()] == [3_000_000, 3_000_000, 2_500_000, None, None, 3_000_000]
    one = spark.range(1)
    assert one.select(text.file_name(F.lit("a/b 图.png")), text.file_name(F.lit("//")), text.topic_side(F.lit("/cam_l/x")), text.column_side(F.lit("cam_r"))).first() == ("a_b_图_png", "unknown", "left", "right")
    assert one.select(text.ns_seconds(F.lit(-1_500_000_001)), text.ns_seconds(F.lit(7))).first() == ("-1.500000001", "0.000000007")
    assert one.select(text.ordered_in(F.lit("a > b > c"), F.array(F.lit("a"), F.lit("c"))), text.ordered_in(F.lit("c > a"), F.array(F.lit("a"), F.lit("c")))).first() == (True, False)
    assert one.select(text.lenient_long(F.lit("1.5")), text.lenient_long(F.lit(" 7 ")), text.first_filled(F.lit(""), F.lit("z"))).first() == (None, 7, "z")


def frame(i, **more):
    item = [{"level": 1, "layer_id": "l1", "id": "e1", "name": "task", "start_timestamp_ns": "0", "end_timestamp_ns": 1000}, {"level": 2, "layerId": "l2", "segmentId": "s1", "prompt": "pick", "startTimeNs": "0", "endTimeNs": "1000"}]
    row = {"file": "f", "row": i, "episode_id": "e", "original_timestamp_ns": i * 10, "frame_index": i, "index": i, "subtask_progress": i / 10, "subtask_id": "s1", "done": i == 4, "task": "task", "subtask": "pick", "annotation.level_1_id": "e1", "annotation.level_1_name": "task", "annotation.leaf_id": "s1", "annotation.leaf_name": "pick", "annotation.path": "task > pick", "annotation.hierarchy_json": json.dumps(item)}
    return row | more


def test_annotation_audit(spark):
    good = spark.createDataFrame(pd.DataFrame([frame(i) for i in range(5)]))
    assert checks.annotation_audit(good, "file", "row").count() == 0
    bad = [frame(0), frame(1, original_timestamp_ns=0), frame(2, frame_index=7), frame(3, subtask_progress=0.0, **{"annotation.path": "pick > task"}), frame(4, done=False, **{"annotation.leaf_name": "drop"})]
    found = {(r.check, r.row_index) for r in checks.annotation_audit(spark.createDataFrame(pd.DataFrame(bad)), "file", "row").collect()}
    assert found == {("increasing", 1), ("frame_index", 2), ("progress", 3), ("path", 3), ("done", 4), ("annotation.leaf_name", 4)}
    broken = spark.createDataFrame(pd.DataFrame([frame(0, done=True, **{"annotation.hierarchy_json": "oops"})]))
    assert {r.check for r in checks.annotation_audit(broken, "file", "row").collect()} == {"hierarchy"}
    summary = checks.annotation_summary(good, "file", "row").orderBy("level").collect()
    assert [(r.id, r.row_count, r.last_timestamp) for r in summary] == [("e1", 5, 40), ("s1", 5, 40)]


def test_capped(spark):
    found = spark.createDataFrame([("c", "e", i) for i in range(5)], "check string, entity string, row_index long")
    r = checks.capped(found, "entity", 3).first()
    assert (r.n, r.messages, r.overflow) == (5, ["c@0", "c@1", "c@2"], 2)


def test_reconcile(spark):
    kind = "task string, level int, ord long, id string, name string, start_ns long, end_ns long"
    e = spark.createDataFrame([("t", 1, 0, "a", "x", 0, 1), ("t", 1, 1, None, "y", 1, 2), ("t", 2, 0, "m", "q", 0, 1)], kind)
    a = spark.createDataFrame([("t", 1, 0, "b", "y", 1, 2), ("t", 1, 1, "a", "x", 0, 5), ("t", 1, 2, "c", "w", 0, 1)], kind)
    got = {(r.expected_id, r.actual_id, r.matched, r.differences) for r in reconcile.match_annotations(e, a, "task").collect()}
    assert got == {("a", "a", "id", "end_ns"), ("", "b", "content", ""), ("m", None, "missing", ""), (None, "c", "unexpected", "")}
    x = spark.createDataFrame([(1, "x", 0.1), (1, "y", 1.0), (2, "x", 1.0)], "k int, label string, value float")
    y = spark.createDataFrame([(1, "x", 0.1004), (1, "y", 1.1)], "k int, label string, value double")
    assert {(r.k, r.label): r.within for r in reconcile.vectors(x, y, ["k"]).collect()} == {(1, "x"): True, (1, "y"): False, (2, "x"): None}


def test_images(spark):
    a = np.arange(48, dtype=np.uint8)
    same = images.pixels(a.tobytes(), 4, 4, "rgb8")
    assert images.compare(same, same)["consistent"] and images.pixels(b"12", 4, 4, "rgb8") is None
    assert (images.pixels(a.tobytes(), 4, 4, "bgr8")[..., 0] == same[..., 2]).all()
    assert images.compare(same, same[:2])["reason"] == "size" and images.compare(same[:2], same, fit=True)["reason"] == ""
    assert images.compare(same * 0, same * 0 + 255)["max_error"] == 255 and images.blur(same * 0 + 9, 1.0).max() == 9
    assert images.pixels(struct.pack("<4H", 0, 256, 512, 65535), 2, 2, "mono16")[..., 0].tolist() == [[0, 1], [2, 255]]
    body = struct.pack("<iI", 1, 2) + struct.pack("<I", 4) + b"cam\0" + struct.pack("<II", 1, 2) + struct.pack("<I", 6) + b"mono8\0" + b"\0" + b"\0" + struct.pack("<I", 2) + struct.pack("<I", 2) + b"\x05\x06"
    got = images.parse_image(b"\0\1\0\0" + body, False)
    assert (got["width"], got["height"], got["data"], got["stamp_ns"]) == (2, 1, b"\x05\x06", 1_000_000_002)
    assert images.parse_image(b"\0\1\0\0" + body[:-3], False) is None
    df = spark.createDataFrame([(bytearray(b"\0\1\0\0" + body), "sensor_msgs/msg/Image"), (bytearray(b"x"), "y")], "d binary, s string")
    assert [r[0].encoding for r in df.select(images.parse_image_udf()("d", "s")).collect()] == ["mono8", None]


def test_mcap(spark, tmp_path):
    text_of = lambda s: struct.pack("<I", len(s)) + s.encode()
    rec = lambda op, b: bytes([op]) + struct.pack("<Q", len(b)) + b
    schema = rec(3, struct.pack("<H", 1) + text_of("S") + text_of("ros2msg") + struct.pack("<I", 0))
    channel = rec(4, struct.pack("<HH", 1, 1) + text_of("/a") + text_of("cdr") + struct.pack("<I", 0)) + rec(4, struct.pack("<HH", 2, 1) + text_of("/b") + text_of("cdr") + struct.pack("<I", 0))
    inside = b"".join(rec(5, struct.pack("<HIQQ", 1 + i % 2, i, 100 + i, 200 + i) + bytes([i])) for i in range(6))
    chunk = rec(6, struct.pack("<QQQI", 100, 105, len(inside), 0) + text_of("") + struct.pack("<Q", len(inside)) + inside)
    (tmp_path / "x.mcap").write_bytes(mcap.MAGIC + rec(1, text_of("") + text_of("")) + schema + channel + chunk + rec(15, struct.pack("<I", 0)) + mcap.MAGIC)
    mcap.register(spark)
    df = spark.read.format("mcap").load(str(tmp_path))
    assert df.count() == 6
    got = mcap.window(spark, str(tmp_path), ["/a"], 102, 105).collect()
    assert [(r.log_ns, r.publish_ns, r.schema_name, bytes(r.data)) for r in sorted(got, key=lambda r: r.seq)] == [(102, 202, "S", b"\2"), (104, 204, "S", b"\4")]
    # with an index: chunks are read by themselves, those outside the bounds not at all
    start = rec(1, text_of("") + text_of(""))
    at = len(mcap.MAGIC) + len(start) + len(schema) + len(channel)
    later = b"".join(rec(5, struct.pack("<HIQQ", 1, i, 500 + i, 0) + b"z") for i in range(2))
    second = rec(6, struct.pack("<QQQI", 500, 501, len(later), 0) + text_of("") + struct.pack("<Q", len(later)) + later)
    body = mcap.MAGIC + start + schema + channel + chunk + second + rec(15, struct.pack("<I", 0))
    entry = lambda low, high, offset, size: rec(8, struct.pack("<QQQQ", low, high, offset, size) + struct.pack("<IQ", 0, 0) + text_of("") + struct.pack("<QQ", 0, 0))
    summary = schema + channel + entry(100, 105, at, len(chunk)) + entry(500, 501, at + len(chunk), len(second))
    whole = body + summary + rec(2, struct.pack("<QQI", len(body), 0, 0)) + mcap.MAGIC
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "y.mcap").write_bytes(whole)
    indexed = spark.read.format("mcap").option("chunk_index", "required").load(str(tmp_path / "sub"))
    assert indexed.count() == 8 and mcap.window(spark, str(tmp_path / "sub"), None, 500, None).count() == 2
    assert [r.log_ns for r in indexed.orderBy("seq").collect()] == [*range(100, 106), 500, 501]
    assert [tuple(r)[1:] for r in mcap.ranges(spark, str(tmp_path)).orderBy("source").collect()] == [(100, 501, 2), (None, None, 0)]
    with pytest.raises(Exception, match="no chunk index"):
        spark.read.format("mcap").option("chunk_index", "required").load(str(tmp_path / "x.mcap")).count()


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).select("id", F.struct(F.lit(b"x").alias("bytes"), F.lit("p").alias("path")).alias("cam")).coalesce(1).write.parquet(path)
    df = tables.frames(spark, path)
    assert [r.row for r in df.orderBy("row").collect()] == [0, 1, 2]
    assert tables.image_columns(df) == ["cam"] and tables.image_integrity(df).first().complete
    assert tables.latest_file(spark, path).first().path.endswith(".parquet") and tables.listing(spark, path).count() >= 1
    (tmp_path / "c.json").write_text(json.dumps({"main_time_topic": "/m", "action": [{"name": "n", "group": "left", "topic": "/t", "fields": ["angle"], "parser": "gripper", "sync_policy": "5"}], "observation_state": []}))
    assert tables.json_config(spark, str(tmp_path / "c.json")).first().grp == "left"


def test_stream(spark, tmp_path):
    from episodelens.streaming import audit

    spark.createDataFrame([("e", 0, 5), ("e", 1, 4)], "entity string, row long, v long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, row long, v long").parquet(str(tmp_path / "in"))
    audit.audit_stream(stream, lambda df: checks.increasing(df, "entity", "row", "v"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().row_index == 1


def test_targets_without_a_match_stay(spark):
    targets = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 5), (4, "z", 5), (5, "a", 10)], "id int, k string, at long")
    frames = spark.createDataFrame([("a", 4, 9), ("a", 4, 2), ("a", 10, 7), ("a", 10, 3), ("a", None, 1), (None, 5, 1), ("a", 30, 4)], "k string, ts long, tie long")
    got = {r.id: (r.before and tuple(r.before), r.after and tuple(r.after)) for r in align.bracket(targets, frames, ["k"], "at", "ts", "tie", [], 7).collect()}
    assert got == {1: ((4, 2), (10, 3)), 2: (None, None), 3: (None, None), 4: (None, None), 5: ((10, 3), (10, 3))}
    near = {r.id: r.nearest and r.nearest.ts for r in align.nearest(targets, frames, ["k"], "at", "ts", "tie", []).collect()}
    assert near == {1: 4, 2: None, 3: None, 4: None, 5: 10}


@pytest.mark.parametrize("bucket", [3, 10, 1000])
def test_brackets_by_brute_force(spark, bucket):
    rng = np.random.default_rng(bucket)
    frames = [(str(rng.integers(2)), int(rng.integers(100)), i) for i in range(60)]
    targets = [(i, str(rng.integers(3)), int(rng.integers(110))) for i in range(40)]
    got = align.bracket(spark.createDataFrame(targets, "id int, k string, at long"), spark.createDataFrame(frames, "k string, ts long, tie long"), ["k"], "at", "ts", "tie", [], bucket)
    for r in got.collect():
        own = [(t, i) for k, t, i in frames if k == r.k]
        before = max((x for x in own if x[0] <= r.at), key=lambda x: (x[0], -x[1]), default=None)
        after = min((x for x in own if x[0] >= r.at), default=None)
        assert (r.before and tuple(r.before), r.after and tuple(r.after)) == (before, after)


def test_match_keeps_nanoseconds_and_nulls(spark):
    kind = "task string, level int, ord long, layer_id string, id string, name string, start_ns long, end_ns long"
    big = 1_700_000_000_000_000_000
    e = spark.createDataFrame([("t", 1, 0, "l1", "a", "x", big, None), ("t", 1, 1, "l1", "b", "y", big, big + 9), ("t", 1, 2, "l1", "d", "w", 1, 2), ("t", 1, 3, "l1", "d", "q", 3, 4)], kind)
    a = spark.createDataFrame([("t", 1, 0, "l1", "a", "x", big + 1, None), ("t", 1, 1, "l9", "b", "y", big, big + 9), ("t", 1, 2, "l1", "d", "q", 3, 4), ("t", 1, 3, "l1", "d", "w", 1, 2)], kind)
    got = {(r.expected_ord, r.actual_ord, r.matched, r.differences) for r in reconcile.match_annotations(e, a, "task").collect()}
    # of several matches by id the one of the same content counts
    assert got == {(0, 0, "id", "start_ns"), (1, 1, "id", "layer_id"), (2, 3, "id", ""), (3, 2, "id", "")}
    assert {(r.level, r.expected_count, r.actual_count) for r in reconcile.level_counts(e, a, "task").collect()} == {(1, 4, 4), (2, 0, 0), (3, 0, 0)}


def test_match_by_brute_force(spark):
    rng = np.random.default_rng(3)
    side = lambda n: [("t", 1, i, str(rng.integers(4)) if rng.random() < 0.7 else "", str(rng.integers(3)), int(rng.integers(3)), 9) for i in range(n)]
    kind = "task string, level int, ord long, id string, name string, start_ns long, end_ns long"
    for n in (5, 30):
        e, a = side(n), side(n)
        left, want = list(a), set()
        for x in e:
            some = [y for y in left if x[3] and y[3] == x[3]] or left
            some = [y for y in some if y[4:] == x[4:]] or some
            if some:
                pick = some[0]
                left.remove(pick)
                want.add((x[2], pick[2]))
            else:
                want.add((x[2], None))
        got = reconcile.match_annotations(spark.createDataFrame(e, kind), spark.createDataFrame(a, kind), "task").collect()
        assert {(r.expected_ord, r.actual_ord) for r in got if r.matched != "unexpected"} == want


def test_counts_are_exact(spark):
    spans = spark.createDataFrame([(33_333_333_299_999_999,), (33_333_333_333_333_333,), (0,), (33_333_333,), (33_333_334,)], "s long")
    got = [r[0] for r in spans.select(checks.frame_count(F.col("s"))).collect()]
    assert got == [r.s * 30 // 10**9 + 1 for r in spans.collect()]


def test_episodes_and_layers(spark):
    top = lambda i, s: json.dumps([{"level": 2, "id": "q"}, {"level": "1", "segmentId": f"e{i}", "prompt": "p", "startTimeNs": s, "endTimeNs": 90}])
    rows = [("f", "a", "0", top(1, 5)), ("f", "a", "0", "bad"), ("g", "a", "1", top(1, 5)), ("g", "b", "1", top(1, 5)), ("h", "a", "x", top(1, 5)), ("i", "a", "0", "[]"), ("j", "a", "0", top(1, 5)), ("j", "a", "0", top(2, 5)), ("k", " ", "0", top(1, 5))]
    df = spark.createDataFrame(rows, "file string, episode_id string, episode_index string, `annotation.hierarchy_json` string")
    got = {r.file: (r.l1_id, r.l1_start_ns, r.problem) for r in checks.episode_index(df, "file").collect()}
    assert got["f"] == ("e1", 5, None) and {k: v[2] for k, v in got.items() if k != "f"} == {"g": "several episodes", "h": "bad episode_index", "i": "no level 1", "j": "several level 1", "k": "blank episode_id"}
    layers = json.dumps([{"layerId": "L3", "segments": [{"segmentId": " s ", "description": "d", "startTimeNs": "7", "endTimeNs": 9}]}, {"segments": [{"id": "t", "prompt": "p"}, {"id": "s", "name": "n", "startTimestampNs": "x"}]}])
    found = checks.expected_layers(spark.createDataFrame([("t", layers)], "task string, json string"), ["task"], "json").orderBy("ord").collect()
    assert [(r.level, r.layer_id, r.id, r.name, r.start_ns, r.end_ns) for r in found] == [(2, "l2", "s", "n", None, None), (2, "l2", "t", "p", None, None), (3, "L3", "s", "d", 7, 9)]
    with pytest.raises(ValueError, match="missing columns"):
        checks.episode_index(df.drop("episode_id"), "file")


def test_report_and_segments(spark):
    found = spark.createDataFrame([("a", "e", 1, "x", "y"), ("a", "e", 2, "x", "y"), ("b", "f", None, None, None)], "check string, entity string, row_index long, expected string, actual string")
    r = checks.report(found, 2).first()
    assert (r.consistent, r.violations, r.by_check, len(r.failures)) == (False, 3, {"a": 2, "b": 1}, 2) and checks.report(found.limit(0)).first().consistent
    segments = spark.createDataFrame([("t", 1, 1, 0, 10), ("t", 1, 2, 2, 30), ("t", 2, 3, 5, 5), ("t", 9, 2, None, 5)], "task string, sequence int, level int, s long, e long").withColumns({"low": F.lit(0), "high": F.lit(20)})
    assert [r.problem for r in checks.segments_within(segments, "s", "e", "low", "high").orderBy("level", "sequence").collect()] == [None, "outside", "no bounds", "empty"]
    assert {(r.level, r.sequence): r.parent_end for r in align.parent_segment(segments, "task", "sequence", "level", "s", "e").collect()} == {(1, 1): 10, (2, 1): 10, (3, 2): None, (2, 9): None}
    assert [tuple(r) for r in checks.duplicates(segments, ["sequence"]).collect()] == [(1, 2)]


def config(path):
    entry = lambda g, kind, i: {"name": "n", "group": g, "topic": f"/{kind}{i}", "fields": vectors.POSITION + vectors.ORIENTATION if kind == "p" else ["angle"], "parser": None, "sync_policy": "5"}
    part = lambda at: [entry(g, kind, at + j) for j, g in enumerate(("left", "right")) for kind in "ph"]
    path.write_text(json.dumps({"main_time_topic": "/m", "cameras": [{"key": "a", "name": "x", "group": "left", "topic": "/1"}, {"key": "b", "name": "y", "group": "right", "topic": "/2"}], "action": part(0) + [entry("left", "h", 7)], "observation_state": part(2)}))
    return str(path)


def test_configuration(spark, tmp_path):
    path = config(tmp_path / "c.json")
    found = conf.entries(spark, path)
    assert len(conf.topic_fields(found)) == 4 and conf.grippers(found)["action", "left"]["topic"] == "/h7"  # the last one counts
    assert conf.vector_topics(found)[:2] == ["/m", "/p0"] and set(conf.topic_tolerances(found).values()) == {5_000_000}
    assert conf.camera_sides(conf.cameras(spark, path, 2)) == {"left": "/1", "right": "/2"}
    for bad in (lambda: conf.cameras(spark, path, 3), lambda: conf.topic_fields(found, ["/none"]), lambda: conf.grippers(found[:2]), lambda: conf.tolerance("-1"), lambda: conf.tolerance("x"), lambda: conf.topic_tolerances([*found, found[0] | {"tolerance_ns": 1}]), lambda: conf.store_conf("http://a/b"), lambda: conf.tasks_table({"job-1": spark.range(1)})):
        with pytest.raises(ValueError):
            bad()
    assert conf.store_conf("http://h:9000")["spark.hadoop.fs.s3a.endpoint"] == "h:9000" and conf.tolerance("0.0000025") == 2
    assert conf.tasks_table({"TASK-1": spark.range(1), "task-2": spark.range(2)}).count() == 3


def test_vector_layout(spark):
    fields = [f"{g}_arm.{x}" if x != "angle" else f"{g}_gripper.data[0]" for g in ("left", "right") for x in vectors.LABELS]
    assert vectors.layout(fields)["right"] == {"indices": list(range(7, 14)), "fields": fields[7:], "slice": [7, 14]}
    assert vectors.layout([*fields[7:], *reversed(fields[:7])])["left"]["slice"] is None
    for bad in (fields[:-1], [*fields, "left_arm.x"], [*fields[:-1], "left_what"], [*fields[:-1], "head.x"]):
        with pytest.raises(ValueError):
            vectors.layout(bad)
    with pytest.raises(ValueError):
        vectors.layout(fields, 3)


def test_vectors_at_the_edges(spark, tmp_path):
    """Clamping, a topic without messages, bounds, and a target without a main frame."""
    found = conf.entries(spark, config(tmp_path / "c.json"))
    pose = lambda v: json.dumps({"pose": {"position": {"x": v, "y": 0, "z": 0}, "orientation": {"x": 0, "y": 0, "z": 0, "w": 2}}})
    ms = 1_000_000
    rows = [("/m", 100 * ms, "{}"), ("/m", 900 * ms, "{}"), ("/p0", 80 * ms, pose(1.0)), ("/p0", 120 * ms, pose(3.0)), ("/p1", 300 * ms, pose(5.0)), ("/h7", 60 * ms, '{"angle": 0}'), ("/h7", 140 * ms, '{"angle": 8}')]
    messages = spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], "rec string, seq long, topic string, log_ns long, json string").withColumn("body", F.parse_json("json"))
    targets = spark.createDataFrame([("r", 1, 130 * ms, 0, 10**12), ("r", 2, 130 * ms, 0, 110 * ms), ("q", 3, 130 * ms, 0, 10**12)], "rec string, target int, at long, s long, e long")
    out = vectors.message_vectors_at(messages, targets, found, ["rec"], "target", "at", start="s", end="e")
    got = {(r.target, r.section, r.grp, r.label): (r.value, r.strategy) for r in out.collect()}
    assert len(got) == 84 and got[1, "action", "left", "x"] == (2.0, "interpolated") and got[1, "action", "left", "angle"] == (4.0, "interpolated")
    assert got[1, "action", "right", "x"] == (5.0, "clamp_first") and got[1, "action", "left", "yaw"][0] == 0 and got[1, "observation_state", "left", "x"] == (None, "single_value")
    assert got[2, "action", "left", "x"] == (1.0, "clamp_last") and got[3, "action", "left", "x"][0] is None


def test_flattening(spark):
    one = lambda text: spark.createDataFrame([(text,)], "j string").select(F.parse_json("j").alias("v"))
    ready = one('{"annotation": {"playback": {"baseline_camera_key": "c", "baseline_start_time_ns": "5", "baseline_end_time_ns": 9}}}')
    made = one('{"timeline": {"start_time_ns": 1, "end_time_ns": 2}, "cameras": [{"camera_key": "a"}, {"camera_key": "b", "segments": [{"global_start_time_ns": 7, "topic": "/t"}]}]}')
    assert tuple(ready.select(flatten.playback(F.col("v"))).first()[0]) == ("c", None, 5, 9)
    assert tuple(made.select(flatten.playback(F.col("v"), "b")).first()[0]) == ("b", "/t", 7, 2) and tuple(made.select(flatten.playback(F.col("v"))).first()[0]) == ("a", None, 1, 2)
    assert one("{}").select(flatten.playback(F.col("v"))).first()[0] is None
    values = spark.range(1).select(flatten.last_reversed(F.array(*map(F.lit, "abc"))), flatten.last_reversed(F.array(F.lit("a"))), flatten.last_reversed(F.array(F.lit("a"), F.lit(" "))))
    assert tuple(values.first()) == (["c", "b"], None, None)
    text = '{"episodes_annotation": [{"label": "x", "startSec": 1, "endSec": 0}, {"startSec": 0, "endSec": 1}, {"label": "y"}]}'
    result = one(text).select(F.lit(1).alias("k"), "v", F.lit("j").alias("job"), F.lit(0).cast("long").alias("base"))
    assert [r.problem for r in flatten.auto_segments(result, "k", "v", "job", "base").orderBy("id").collect()] == ["ends before it starts", "no description"]
    times = flatten.time_fields(spark.createDataFrame([(3, 5, 4)], "s long, e long, b long"), "s", "e", "b").first()
    assert (times.relative_start_ns, times.relative_start_time, times.end_time) == (-1, "-0.000000001", "0.000000005")
    assert flatten.identify(spark.range(9), "n", "seg-", 5).select("n").distinct().count() == 9


def test_png_and_sinks(spark, tmp_path):
    rng = np.random.default_rng(1)
    for shape in ((3, 5), (4, 2, 3), (1, 7, 4)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (png.decode(png.encode(image)).reshape(shape) == image).all()
    data = png.encode(rng.integers(0, 256, (2, 2, 3)).astype(np.uint8))
    assert png.decode(data[:-20]) is None and png.decode(b"x") is None
    filtered = bytearray(b"".join(bytes([k, *rng.integers(0, 256, 6)]) for k in range(5)))
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"
    raw = png.MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", 2, 5, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(bytes(filtered))) + part(b"IEND", b"")
    assert png.decode(raw).shape == (5, 2, 3)
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"junk")), ("c", None)], "name string, data binary").withColumn("image", image_audit.pixels_udf()("data", F.lit(""))).withColumn("note", F.lit(1))
    got = {r.name: r.kind for r in sinks.save_images(df, str(tmp_path), "name", "image", "data", ["note"]).collect()}
    assert got == {"a": "png", "b": "bin", "c": "none"} and json.loads((tmp_path / "a.json").read_text()) == {"note": 1} and (tmp_path / "b.bin").read_bytes() == b"junk"
    assert (png.decode((tmp_path / "a.png").read_bytes()) == png.decode(data)).all()
    assert [r.bytes > 0 for r in sinks.save_differences(df.where("name = 'a'"), str(tmp_path / "d"), "name", "image", "image").collect()] == [True]
    assert spark.range(1).select(sinks.artefact(F.lit("a/b"), F.lit(""), F.lit(3))).first()[0] == "a_b_3"
    line = image_audit.compare_pairs(df, "image", "image", ["name"]).select(image_audit.summary_text(F.col("name")).alias("t")).orderBy("t").collect()
    assert [r.t for r in line] == ["a agrees ratio=1.0000 mae=0.000 max=0", "b differs ratio=- mae=- max=- undecodable", "c differs ratio=- mae=- max=- undecodable"]


def test_more_sources(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "one" / "data"))
    assert tables.only_child(spark, str(tmp_path), "data").endswith("one/data") and len(tables.parquet_files(spark, str(tmp_path))) >= 1
    foot = tables.footers(spark, tables.parquet_files(spark, str(tmp_path))).agg(F.sum("filled"), F.sum("nulls")).first()
    assert tuple(foot) == (5, 0)
    for bad in (lambda: tables.only_child(spark, str(tmp_path / "one"), "none"), lambda: tables.parquet_files(spark, str(tmp_path / "one" / "none"))):
        with pytest.raises(Exception):
            bad()
    pages = tables.paged(spark, lambda page, size: ([{"i": (page - 1) * size + k} for k in range(size if page < 3 else 1)], 3), 4)
    assert sorted(json.loads(r.json)["i"] for r in pages.collect()) == list(range(9))
    assert spark.createDataFrame([("s3://b/set/data/chunk-000/e1.parquet",)], "p string").select(tables.video_path("p", "cam")).first()[0] == "s3://b/set/videos/cam/chunk-000/e1.mp4"


def test_spans_hold_points_by_brute_force(spark):
    rng = np.random.default_rng(6)
    points = [("a", int(x)) for x in rng.integers(-50, 50, 60)] + [(None, 1), ("a", None)]
    spans = [("a", int(s), int(s + w)) for s, w in zip(rng.integers(-60, 60, 30), rng.integers(-3, 40, 30), strict=True)] + [("a", 1, 1), ("a", None, 3), ("b", 0, 9)]
    got = align.contained(spark.createDataFrame(spans, "k string, s long, e long"), spark.createDataFrame(points, "k string, at long"), ["k"], "s", "e", "at", 7).collect()
    assert len(got) == len(spans)
    for r in got:
        assert r.inside == (0 if r.s is None else sum(k == r.k and t is not None and r.s <= t <= r.e for k, t in points))
