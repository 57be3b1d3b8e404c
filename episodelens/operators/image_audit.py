"""Images of raw messages, of frame tables and of videos, matched in time and compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import align, images, png

IMAGE = "data binary, width int, height int, encoding string, step int"


def decode_any(data: bytes | None) -> dict | None:
    """Pixels of an encoded image: PNG, and what Pillow reads where that is installed."""
    found = png.decode(bytes(data)) if data is not None else None
    if found is None and data is not None:
        try:
            import io

            from PIL import Image

            found = np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
        except (ImportError, OSError, ValueError):
            return None
    if found is None:
        return None
    return {"data": found.tobytes(), "width": found.shape[1], "height": found.shape[0], "encoding": {1: "mono8", 3: "rgb8", 4: "rgba8"}[found.shape[2]], "step": found.shape[1] * found.shape[2]}


def pixels_udf():
    """UDF of bytes and schema name: pixels of an encoded image, or of a raw or compressed image message; nulls where it is neither."""

    def one(data, schema) -> dict:
        none = dict.fromkeys(("data", "width", "height", "encoding", "step"))
        if data is None:
            return none
        found = decode_any(data)
        for compressed in (False, True) if found is None else ():
            if "Image" in (schema or "") and ("CompressedImage" in schema) != compressed:
                continue
            got = images.parse_image(data, compressed)
            got = decode_any(got["data"]) if got and compressed else got
            if got and images.pixels(got["data"], got["width"], got["height"], got["encoding"], got["step"]) is not None:
                found = {k: got[k] for k in none}
                break
        return found or none

    @F.pandas_udf(IMAGE)
    def run(data: pd.Series, schema: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(d, s) for d, s in zip(data, schema, strict=True)], columns=["data", "width", "height", "encoding", "step"]).astype({"width": "Int32", "height": "Int32", "step": "Int32"})

    return run


def message_images_at(messages: DataFrame, targets: DataFrame, topics: list[str], keys: list[str], target: str, at: str, window_ns: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(target, topic, matched_ns, seq, diff_ns, schema_name, data): the message of each topic nearest to each target, in the window and bounds; keys may hold the source, for one a file.

    Times and places are matched first; only matched messages bring their data.
    """
    bounds = [c for c in (start, end) if c]
    wanted = targets.select(*dict.fromkeys([*keys, target, at, *bounds]), F.explode(F.array(*map(F.lit, topics))).alias("topic"))
    some = messages.where(F.col("topic").isin(topics))
    both = align.bracket(wanted, some.select(*keys, "topic", "log_ns", "seq"), [*keys, "topic"], at, "log_ns", "seq", [])
    inside = lambda c: align.within(F.col(c), F.col(at), window_ns, F.col(start) if start else None, F.col(end) if end else None)
    both = both.withColumns({"before": inside("before"), "after": inside("after")}).withColumn("near", align.closest(F.col("before"), F.col("after"), F.col(at)))
    found = both.select(*keys, target, "topic", F.col("near.ts").alias("matched_ns"), F.col("near.tie").alias("seq"), F.abs(F.col("near.ts") - F.col(at)).alias("diff_ns"))
    bodies = some.select(*keys, "topic", "seq", "log_ns", "schema_name", "data").withColumnRenamed("log_ns", "matched_ns")
    return found.join(bodies, [*keys, "topic", "seq", "matched_ns"], "left").select(target, "topic", "matched_ns", "seq", "diff_ns", "schema_name", "data")


def frame_images_at(frames: DataFrame, targets: DataFrame, columns: list[str], keys: list[str], target: str, at: str, ts: str, row: str) -> DataFrame:
    """(target, camera, matched_ns, row, diff_ns, data): image cells of the frame nearest to each target among frames of the same keys; all targets are matched at once, and only matched rows bring their images."""
    found = align.nearest(targets.select(*dict.fromkeys([*keys, target, at])), frames.select(*keys, ts, row), keys, at, ts, row, [])
    found = found.select(*keys, target, F.col("nearest.ts").alias("matched_ns"), F.col("nearest.tie").alias(row), "diff_ns")
    cells = frames.select(*keys, row, F.explode(F.array(*(F.struct(F.lit(c).alias("camera"), F.col(f"`{c}`.bytes").alias("data")) for c in columns))).alias("i"))
    return found.join(cells, [*keys, row]).select(target, "i.camera", "matched_ns", F.col(row).alias("row"), "diff_ns", "i.data")


def compare_pairs(pairs: DataFrame, left: str, right: str, keys: list[str], **limits) -> DataFrame:
    """keys with the comparison of two columns of pixels; undecodable or absent images aren't consistent."""
    return pairs.select(*keys, images.compare_udf(**limits)(left, right).alias("c")).select(*keys, "c.*")


def three_way(raw: DataFrame, video: DataFrame, cells: DataFrame, target: str, camera: str, **limits) -> DataFrame:
    """(target, camera, pair, same_row, comparison) of raw with video, raw with cells, cells with video.

    Each side: target, camera, row, image (pixels); same_row: the video's frame
    is the row that the cell comes from.
    """
    keys = [target, camera]
    one = lambda df, name: df.select(*keys, F.col("image").alias(name), F.col("row").alias(f"{name}_row"))
    every = one(raw, "raw").join(one(video, "video"), keys, "full").join(one(cells, "cell"), keys, "full")
    same = F.col("video_row").eqNullSafe(F.col("cell_row")).alias("same_row")
    pair = lambda name, a, b: F.struct(F.lit(name).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b"))
    rows = every.select(*keys, same, F.explode(F.array(pair("raw_video", "raw", "video"), pair("raw_cell", "raw", "cell"), pair("cell_video", "cell", "video"))).alias("p")).select(*keys, "same_row", "p.*")
    return compare_pairs(rows, "a", "b", [*keys, "pair", "same_row"], **limits)


def summary_text(name: Column) -> Column:
    """A line on a comparison's columns."""
    number = lambda c, f: F.when(F.col(c).isNull(), "-").otherwise(F.format_string(f, F.col(c)))
    return F.concat_ws(" ", name, F.when(F.col("consistent"), "agrees").otherwise("differs"), F.concat(F.lit("ratio="), number("matched_ratio", "%.4f")), F.concat(F.lit("mae="), number("mae", "%.3f")), F.concat(F.lit("max="), F.coalesce(F.col("max_error").cast("string"), F.lit("-"))), F.nullif(F.col("reason"), F.lit("")))
