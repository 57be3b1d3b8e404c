"""Written tables in the cluster's shared folder, joins on hot keys, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; an own one only where that is unset and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="episodelens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of the Arrow batches that Python workers get.
BATCH_BYTES = 8 << 20
#: Rows of a Parquet reader's vectors: texts are long, and vectors of the default 4096 rows take tens of MB of heap a task.
READER_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers and of Parquet readers, for texts may be long; the session keeps the settings."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


_RUNS: list[Tables] = []


def clean() -> None:
    """Removes the intermediate tables of all operator runs of this driver; results that were not written are lost with them.  Runs when the driver ends."""
    while _RUNS:
        with suppress(Exception):  # the JVM may be gone
            _RUNS.pop().drop()


atexit.register(clean)


class Tables:
    """Intermediate tables of one operator run: written once, read many times, removed by clean()."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _RUNS.append(self)

    def keep(self, df: DataFrame, name: str, few: list[str] | None = None) -> DataFrame:
        """Writes df as Parquet, which cuts its lineage, and returns a scan of it.

        few: columns to deal rows by first, where many tasks make little each:
        AQE then writes a few files of its advisory size, not one for each task.
        """
        if few:
            df = df.hint("rebalance", *few)
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes a table, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of fewer bytes are dealt anew, for all their rows may lie in one row group, which only one task can read.
SMALL_TABLE = 32 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_TABLE:
        return found.repartition(spark.sparkContext.defaultParallelism)
    return found


def sealed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[str]]:
    """docs whose columns, but for those of keep, have names that no operator uses; and these names, in order."""
    names, left = [], list(keep)
    for i, c in enumerate(docs.columns):
        names.append(c if c in left else f"_c{i}")
        if c in left:
            left.remove(c)
    return docs.toDF(*names), names


#: A key is hot if it holds more than one of so many rows: there are fewer hot keys than this.
HOT = 1000


def hot_join(rows: DataFrame, found: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with found (one row a key, no more) on keys; n: column of found, how many rows have the key.

    Fewer than HOT keys can be hot, so these may be broadcast whatever the
    input; rows of other keys meet theirs by a shuffle in which no key has more
    than one in HOT of all rows.
    """
    hot = found.where(F.col(n) * HOT > total)
    mark = hot.select(*keys, F.lit(True).alias("_hot"))
    near = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(mark), keys, "left").where("_hot is null").drop("_hot")
    return near.unionByName(rest.join(found.where(F.col(n) * HOT <= total), keys))


def components(tables: Tables, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label): label is the smallest node reachable by edges (a, b); nodes without an edge are absent.

    Alternates large-star and small-star steps.  Each is an aggregate (with
    map-side combine) and an equi-join, so a hub of any degree is spread by
    the skew join; tables are written each round, nothing comes to the driver
    but two numbers per round.
    """
    spread = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = tables.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state, k = mark, k + 1
        both = spread(now)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = tables.keep(large, f"{name}-{k}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = tables.keep(small, f"{name}-{k}")
        tables.drop(f"{name}-{k}-large")
        tables.drop(f"{name}-{k - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
