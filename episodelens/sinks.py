"""Results written out: images, their differences, reports and profiles.

Folders are URIs or paths that all executors reach; a repeated task replaces
whole files, so lost executors leave no halves.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import file_name
from .operators import images, png


def artefact(*parts: Column) -> Column:
    """A file's name of parts, in order; blank ones go."""
    return F.concat_ws("_", *(F.when(F.trim(F.coalesce(p.cast("string"), F.lit(""))) != "", file_name(p.cast("string"))) for p in parts))


def _put(folder: str, name: str, data: bytes) -> int:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(data)
    return len(data)


def save_images(rows: DataFrame, folder: str, name: str, image: str, raw: str | None = None, metadata: list[str] | None = None) -> DataFrame:
    """Writes <name>.png of pixels (struct data, width, height, encoding, step); where they don't decode, <name>.bin of the raw column; with metadata, <name>.json of these columns.  (name, kind, bytes), written when it is evaluated; kind is png, bin or none."""
    kept = metadata or []
    extra = F.to_json(F.struct(*kept)) if kept else F.lit(None).cast("string")
    source = F.col(raw) if raw else F.lit(None).cast("binary")

    @F.pandas_udf("kind string, bytes long")
    def put(names: pd.Series, pixels: pd.DataFrame, raws: pd.Series, notes: pd.Series) -> pd.DataFrame:
        out = []
        for n, p, r, note in zip(names, pixels.itertuples(index=False), raws, notes, strict=True):
            found = images.row_pixels(p)
            if found is not None:
                out.append(("png", _put(folder, f"{n}.png", png.encode(np.clip(found, 0, 255)))))
            elif r is not None:
                out.append(("bin", _put(folder, f"{n}.bin", bytes(r))))
            else:
                out.append(("none", 0))
            if note is not None:
                _put(folder, f"{n}.json", json.dumps(json.loads(note), ensure_ascii=False, indent=1).encode())
        return pd.DataFrame(out, columns=["kind", "bytes"])

    return rows.select(F.col(name).alias("name"), put(name, image, source, extra).alias("w")).select("name", "w.*")


def save_differences(pairs: DataFrame, folder: str, name: str, left: str, right: str) -> DataFrame:
    """Writes <name>.png of the differences (four times, clipped) of two columns of pixels of equal size; others write nothing.  (name, bytes)."""

    @F.pandas_udf("long")
    def put(names: pd.Series, a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for n, x, y in zip(names, a.itertuples(index=False), b.itertuples(index=False), strict=True):
            x, y = images.row_pixels(x), images.row_pixels(y)
            fits = x is not None and y is not None and x.shape == y.shape
            out.append(_put(folder, f"{n}.png", png.encode(np.clip(np.abs(x - y) * 4, 0, 255))) if fits else 0)
        return pd.Series(out, dtype="int64")

    return pairs.select(F.col(name).alias("name"), put(name, left, right).alias("bytes"))


def write_report(report: DataFrame, folder: str) -> None:
    """A report's rows as JSON lines."""
    report.write.mode("overwrite").json(folder)
