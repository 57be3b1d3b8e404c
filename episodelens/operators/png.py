"""PNG images of 8 bits, after the public format description: gray, RGB and RGBA, without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
CHANNELS = {0: 1, 2: 3, 6: 4}


def encode(image: np.ndarray) -> bytes:
    """image: height, width and 1, 3 or 4 channels (none for gray), as bytes."""
    image = image[:, :, None] if image.ndim == 2 else image
    height, width, channels = image.shape
    kind = {v: k for k, v in CHANNELS.items()}[channels]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.astype(np.uint8).reshape(height, -1)], 1)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step).astype(np.uint64), 0).astype(np.uint8).ravel()
    if kind == 2:
        return row + above
    out, up = row.astype(int).tolist(), above.astype(int).tolist()
    for i in range(len(out)):
        a, b = out[i - step] if i >= step else 0, up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = up[i - step] if i >= step else 0
            near = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
            guess = (a, b, c)[near.index(min(near))]
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def decode(data: bytes) -> np.ndarray | None:
    """height, width, channels; None for what isn't such an image, or is damaged."""
    if not data or not data.startswith(MAGIC):
        return None
    at, head, body = len(MAGIC), None, []
    try:
        while at < len(data):
            (n,) = struct.unpack_from(">I", data, at)
            name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif name == b"IDAT":
                body.append(part)
            at += n + 12
        width, height, depth, kind, _, _, laced = head
        if depth != 8 or kind not in CHANNELS or laced:
            return None
        step = CHANNELS[kind]
        rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
        out, above = np.empty((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
        for i in range(height):
            above = out[i] = _unfilter(int(rows[i, 0]), rows[i, 1:], above, step)
        return out.reshape(height, width, step)
    except (struct.error, zlib.error, TypeError, ValueError):
        return None
