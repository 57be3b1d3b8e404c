"""Tables and files as DataFrames."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frames(spark: SparkSession, *paths: str) -> DataFrame:
    """Frame tables with file and row: physical order, as audits need it."""
    if not paths:
        raise ValueError("no source")
    return spark.read.option("recursiveFileLookup", True).parquet(*paths).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def latest_file(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """One row: path of the newest file of the folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select("path", "modificationTime", "length").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: path, relative path, size; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return found.where("length > 0").withColumn("relative", F.regexp_extract("path", f"{folder.rstrip('/').rpartition('/')[2]}/(.*)$", 1)).orderBy("path")


def profile(df: DataFrame) -> DataFrame:
    """Per column: values and nulls, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("_n").alias("rows"), F.col(f"`{c}`").alias("filled")) for c in df.columns)))
    return counts.select(pairs.alias("p")).select("p.column", "p.rows", (F.col("p.rows") - F.col("p.filled")).alias("nulls"))


def image_columns(df: DataFrame) -> list[str]:
    """Columns that are structs with bytes and path."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "struct" and {"bytes", "path"} <= set(f.dataType.names)]


def image_integrity(df: DataFrame) -> DataFrame:
    """Per image column: rows, values and nulls of its bytes, complete."""
    found = df.select(*(F.col(f"`{c}`.bytes").alias(c) for c in image_columns(df)))
    return profile(found).withColumn("complete", (F.col("nulls") == 0) & (F.col("rows") > 0))


def json_config(spark: SparkSession, path: str) -> DataFrame:
    """Robot configuration: one row for each configured topic: section, position, name, grp, topic, fields, parser, sync_policy."""
    raw = spark.read.option("multiLine", True).schema("action array<struct<name string, group string, topic string, fields array<string>, parser string, sync_policy string>>, observation_state array<struct<name string, group string, topic string, fields array<string>, parser string, sync_policy string>>, main_time_topic string").json(path)
    part = lambda s: raw.select(F.lit(s).alias("section"), F.col("main_time_topic"), F.posexplode(s).alias("position", "e"))
    return part("action").unionByName(part("observation_state")).select("section", "main_time_topic", "position", "e.name", F.col("e.group").alias("grp"), "e.topic", "e.fields", "e.parser", "e.sync_policy")


def jdbc(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """A database table; connection options come from the caller's configuration."""
    return spark.read.format("jdbc").options(dbtable=name, **options).load()


def _files(spark: SparkSession, folder: str):
    """(Hadoop file system, path) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def parquet_files(spark: SparkSession, folder: str) -> list[str]:
    """Parquet files below a folder that hold something, sorted; an error if there are none, or if one is empty."""
    store, path = _files(spark, folder)
    found, walk = [], store.listFiles(path, True)
    while walk.hasNext():
        status = walk.next()
        if (name := status.getPath().toString()).endswith(".parquet"):
            if not status.getLen():
                raise ValueError(f"{name} is empty")
            found.append(name)
    if not found:
        raise FileNotFoundError(f"no Parquet file below {folder}")
    return sorted(found)


def only_child(spark: SparkSession, folder: str, below: str = "") -> str:
    """The only folder in a folder, or a folder below it, which must be there."""
    store, path = _files(spark, folder)
    inside = [s.getPath().toString() for s in store.listStatus(path) if s.isDirectory()]
    if len(inside) != 1:
        raise ValueError(f"{folder} has {len(inside)} folders")
    wanted = f"{inside[0]}/{below}".rstrip("/")
    if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(wanted)):
        raise FileNotFoundError(wanted)
    return wanted


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, row_group, rows, column, filled, nulls) of Parquet files, from their footers alone; filled and nulls are null where statistics are missing.  Few files: the driver reads them; cache() keeps them."""
    reader, source = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader, spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile
    conf, out = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        opened = reader.open(source.fromPath(spark._jvm.org.apache.hadoop.fs.Path(p), conf))
        try:
            for g, block in enumerate(opened.getFooter().getBlocks()):
                for column in block.getColumns():
                    stats = column.getStatistics()
                    known = stats is not None and stats.isNumNullsSet()
                    nulls = stats.getNumNulls() if known else None
                    out.append((p, g, block.getRowCount(), column.getPath().toDotString(), column.getValueCount() - nulls if known else None, nulls))
        finally:
            opened.close()
    return spark.createDataFrame(out, "file string, row_group int, rows long, column string, filled long, nulls long")


def paged(spark: SparkSession, fetch, size: int = 100) -> DataFrame:
    """Rows of a paged service as JSON text: fetch(page, size) gives (rows, number of pages) and runs in executors for all pages but the first."""
    first, pages = fetch(1, size)
    head = spark.createDataFrame([(json.dumps(r),) for r in first], "json string")
    if pages <= 1:
        return head

    def run(batches):
        for batch in batches:
            for page in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in fetch(page, size)[0]], pa.string())], ["json"])

    return head.unionByName(spark.range(2, pages + 1, numPartitions=min(pages - 1, 1000)).mapInArrow(run, "json string"))


def video_path(parquet: str | Column, column: str) -> Column:
    """Path of the video of an image column, from an episode's Parquet path: <dataset>/data/<chunk>/<episode>.parquet -> <dataset>/videos/<column>/<chunk>/<episode>.mp4."""
    c = F.col(parquet) if isinstance(parquet, str) else parquet
    return F.regexp_replace(c, r"^(.*)/data/([^/]+)/([^/]+)\.parquet$", f"$1/videos/{column}/$2/$3.mp4")


def video_frames(wanted: DataFrame) -> DataFrame:
    """(path, frame, width, height, data): RGB frames of videos, decoded once a file and no further than the last wanted one; a missing frame is an error.  Needs PyAV on executors."""

    def run(batches):
        import av

        from .mcap import open_file

        for batch in batches:
            for path, frames in zip(batch.column("path").to_pylist(), batch.column("frames").to_pylist(), strict=True):
                left = set(frames)
                with open_file(path) as raw, av.open(raw) as video:
                    for n, picture in enumerate(video.decode(video=0)):
                        if n in left:
                            left.discard(n)
                            pixels = picture.to_ndarray(format="rgb24")
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([pixels.shape[1]], pa.int32()), pa.array([pixels.shape[0]], pa.int32()), pa.array([pixels.tobytes()], pa.binary())], ["path", "frame", "width", "height", "data"])
                        if not left:
                            break
                if left:
                    raise ValueError(f"{path} lacks frames {sorted(left)[:5]}")

    return wanted.groupBy("path").agg(F.sort_array(F.collect_set("frame")).alias("frames")).mapInArrow(run, "path string, frame long, width int, height int, data binary")
