"""Pixel kernels and comparison, as Arrow-batched pandas UDFs.

Images are raw bytes with width, height, encoding and row step.  Resizing is
bicubic (a = -0.5) and blurring Gaussian, both in numpy.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

DIFF, RATIO, MAE = 10, 0.95, 3.0
#: Channels, bytes of a channel, order of channels for RGB.
ENCODINGS = {"rgb8": (3, 1, (0, 1, 2)), "bgr8": (3, 1, (2, 1, 0)), "rgba8": (4, 1, (0, 1, 2)), "bgra8": (4, 1, (2, 1, 0)), "mono8": (1, 1, (0, 0, 0)), "8uc1": (1, 1, (0, 0, 0)), "mono16": (1, 2, (0, 0, 0)), "16uc1": (1, 2, (0, 0, 0))}


def pixels(data: bytes, width: int, height: int, encoding: str, step: int = 0, big: bool = False) -> np.ndarray | None:
    """RGB pixels (height, width, 3) of int16; 16-bit values are scaled to 8; None where the bytes don't fit."""
    known = ENCODINGS.get((encoding or "").lower())
    if known is None or not data or width <= 0 or height <= 0:
        return None
    channels, size, order = known
    row = width * channels * size
    step = step or row
    if step < row or len(data) < step * (height - 1) + row:
        return None
    raw = np.frombuffer(data[: step * height].ljust(step * height, b"\0"), np.uint8).reshape(height, step)[:, :row]
    values = raw.reshape(height, width, channels) if size == 1 else (np.ascontiguousarray(raw).view(">u2" if big else "<u2").reshape(height, width, channels) // 256)
    return values[:, :, list(order)].astype(np.int16)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic, with the kernel widened when it shrinks."""

    def along(x: np.ndarray, size: int) -> np.ndarray:
        scale = x.shape[0] / size
        wide = max(scale, 1.0)
        centre = (np.arange(size) + 0.5) * scale
        at = np.floor(centre[:, None] - 2 * wide + np.arange(int(np.ceil(4 * wide)) + 1)[None]).astype(int)
        t = np.abs((at + 0.5 - centre[:, None]) / wide)
        w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0)) * ((at >= 0) & (at < x.shape[0]))
        return np.einsum("ok,ok...->o...", w / w.sum(1, keepdims=True), x[np.clip(at, 0, x.shape[0] - 1)])

    out = along(image.astype(float), height)
    return np.clip(np.rint(along(out.swapaxes(0, 1), width).swapaxes(0, 1)), 0, 255).astype(np.int16)


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    out = image.astype(float)
    for axis in (0, 1):
        pad = [(reach, reach) if i == axis else (0, 0) for i in range(out.ndim)]
        padded = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(padded, np.arange(out.shape[axis]) + i, axis) for i, w in enumerate(k))
    return np.rint(out).astype(np.int16)


def compare(a: np.ndarray | None, b: np.ndarray | None, diff: int = DIFF, ratio: float = RATIO, mae: float = MAE, fit: bool = False, sigma: float = 0.0) -> dict:
    """Share of pixels whose channels differ by `diff` at most, mean and largest error, verdict; sizes must agree unless fit."""
    none = {"matched_ratio": None, "mae": None, "max_error": None}
    if a is None or b is None:
        return none | {"consistent": False, "reason": "undecodable"}
    if a.shape != b.shape:
        if not fit:
            return none | {"consistent": False, "reason": "size"}
        a = resize(a, *b.shape[:2])
    if sigma > 0:
        a, b = blur(a, sigma), blur(b, sigma)
    error = np.abs(a - b)
    matched, mean = float((error.max(-1) <= diff).mean()), float(error.mean())
    return {"matched_ratio": matched, "mae": mean, "max_error": int(error.max()), "consistent": matched >= ratio and mean <= mae, "reason": ""}


RESULT = "matched_ratio double, mae double, max_error int, consistent boolean, reason string"


def row_pixels(row) -> np.ndarray | None:
    """Pixels of a row (data, width, height, encoding, and step if it has one) of a pandas UDF; None where a field is null or they don't decode."""
    number = lambda v: 0 if v is None or pd.isna(v) else int(v)
    if not isinstance(row.data, (bytes, bytearray, memoryview)) or not isinstance(row.encoding, str):
        return None
    return pixels(bytes(row.data), number(row.width), number(row.height), row.encoding, number(getattr(row, "step", 0)))


def compare_udf(diff: int = DIFF, ratio: float = RATIO, mae: float = MAE, fit: bool = False, sigma: float = 0.0):
    """UDF of two structs (data, width, height, encoding)."""

    @F.pandas_udf(RESULT)
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = [compare(row_pixels(x), row_pixels(y), diff, ratio, mae, fit, sigma) for x, y in zip(a.itertuples(), b.itertuples(), strict=True)]
        return pd.DataFrame(rows, columns=["matched_ratio", "mae", "max_error", "consistent", "reason"]).astype({"max_error": "Int32"})

    return run


class Cdr:
    """Little reader of the CDR wire format; alignment counts from the end of the 4-byte header."""

    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 4, "<" if data[1] & 1 else ">"

    def number(self, kind: str):
        size = struct.calcsize(kind)
        self.at += -(self.at - 4) % size
        (value,) = struct.unpack_from(self.order + kind, self.data, self.at)
        self.at += size
        return value

    def blob(self) -> bytes:
        n = self.number("I")
        if self.at + n > len(self.data):
            raise ValueError("short")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        return self.blob().rstrip(b"\0").decode()


def parse_image(data: bytes, compressed: bool) -> dict | None:
    """Header and bytes of a raw or compressed image message; None on any damage."""
    try:
        r = Cdr(data)
        stamp = r.number("i") * 10**9 + r.number("I")
        frame = r.text()
        if compressed:
            return {"stamp_ns": stamp, "frame": frame, "encoding": r.text(), "width": 0, "height": 0, "step": 0, "data": r.blob()}
        height, width, encoding, _, step = r.number("I"), r.number("I"), r.text(), r.number("B"), r.number("I")
        return {"stamp_ns": stamp, "frame": frame, "encoding": encoding, "width": width, "height": height, "step": step, "data": r.blob()}
    except (struct.error, ValueError, IndexError, UnicodeDecodeError):
        return None


IMAGE = "stamp_ns long, frame string, encoding string, width int, height int, step int, data binary"


def parse_image_udf():
    """UDF of message bytes and schema name; tries both kinds where the name tells nothing."""

    @F.pandas_udf(IMAGE)
    def run(data: pd.Series, schema: pd.Series) -> pd.DataFrame:
        rows = []
        for d, s in zip(data, schema, strict=True):
            kinds = (True,) if "CompressedImage" in (s or "") else (False,) if "Image" in (s or "") else (False, True)
            rows.append(next((x for k in kinds if d is not None and (x := parse_image(d, k))), None) or dict.fromkeys(("stamp_ns", "frame", "encoding", "width", "height", "step", "data")))
        return pd.DataFrame(rows).astype({"stamp_ns": "Int64", "width": "Int32", "height": "Int32", "step": "Int32"})

    return run
