"""A training-corpus pipeline of five of the operators in episodelens.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of docs.

language_id     drops documents without a letter or text, and those whose best
                language has a posterior under REJECT_BELOW (none for that where
                no language could be learned)
ngram_join      keeps one row of each group of near copies: the one with the
                smallest doc_id (null after all others, then the first row); rows
                that repeat a doc_id are documents of their own
substring_dedup removes words of passages that occur again; a text that loses
                words becomes its kept words joined by one space, n_chars follows
mix_sources     orders documents by their slot in the mix of sources: partitions
                are ranges of slots, in order, and so are rows in them
sentencepiece   encodes texts to pieces; mix_position numbers the rows of its docs
                in order of (file name, row), so it is the order of mix_sources
                however later files are split and read; run() returns rows in it
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodelens.llm import language_id, ngram_join, piece_lattice, source_mixing, substring_dedup
from episodelens.llm._shared import Tables, documents, sealed

REJECT_BELOW = 0.3
#: SQL can't express language ID or the piece lattice.
ORACLE_SQL = None


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that ascends in the order of rows: of files by name.  What isn't read from files is written first, for its order may change."""
    place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    try:
        rows = docs.select("*", *place)
    except AnalysisException:
        rows = Tables(docs.sparkSession, "numbered").keep(docs, "rows").select("*", *place)
    files = rows.groupBy("_file").agg((F.max("_at") + 1).alias("n")).orderBy("_file").collect()  # a row per file
    starts, at = [], 0
    for f in files:
        starts.append((f["_file"], at))
        at += f["n"]
    start = docs.sparkSession.createDataFrame(starts, "_name string, _start long")
    placed = rows.join(F.broadcast(start), F.col("_file") == F.col("_name"), "left")
    return placed.withColumn(name, F.col("_start") + F.col("_at")).drop("_file", "_at", "_name", "_start")


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs whose language is told: null, empty and letterless texts go, ties take the first language by name, rows that repeat a doc_id are judged each, an empty table stays empty; all columns stay, whatever their names."""
    known, table = language_id.train(docs)
    if not known:  # nothing was learned: no document is rejected for its language
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows, names = sealed(docs)
    kept = language_id.predict(rows, known, table).where((F.col("lang_pred") != "und") & (F.col("score") >= REJECT_BELOW))
    return kept.select(*names).toDF(*docs.columns)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each group of near copies; empty and null texts are groups of their own, null doc_ids take part, an empty table stays empty; all columns stay, whatever their names."""
    rows, names = sealed(docs)
    rows = _numbered(rows, "_row")
    groups = ngram_join.ngram_jaccard_join(spark, rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_own"), "component_id")
    ids = rows.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("order"))
    heads = groups.join(ids, F.col("_own") == F.col("_row")).groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(heads, "_row", "left_semi").select(*names).toDF(*docs.columns)


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, without the words of repeated passages; null and short texts stay as they are, equal rows are texts of their own, an empty table stays empty; all columns stay, whatever their names."""
    rows, names = sealed(docs)
    out = substring_dedup.substring_dedup(rows).withColumn("text", F.coalesce("kept_text", "text"))  # null unless a word went
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(F.col("kept_text").isNull(), F.col(n)).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names).toDF(*docs.columns)


def stage_mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs in order of the mix; a null source is a source, null sizes count as 0, rows alike in doc_id and text take the first slot of theirs, an empty table stays empty; all columns stay, whatever their names."""
    plan = source_mixing.mix_sources(docs).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("slot").alias("_slot")).groupBy("_id", "_tie").agg(F.min("_slot").alias("_slot"))
    rows, names = sealed(docs)
    placed = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tie")))
    return placed.repartitionByRange("_slot", "doc_id").sortWithinPartitions("_slot", "doc_id").select(*names).toDF(*docs.columns)


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows of docs: null texts give null lists, empty ones no pieces, damaged UTF-8 counts as U+FFFD, equal rows are encoded each, an empty table stays empty; columns of docs but text stay, those named as the new ones are replaced."""
    return piece_lattice.encode(_numbered(docs, "mix_position"), keep_text=False).drop("ids_md5")


STAGES = [
    ("language_id", stage_language_id),
    ("ngram_join", stage_ngram_join),
    ("substring_dedup", stage_substring_dedup),
    ("mix_sources", stage_mix_sources),
    ("sentencepiece", stage_sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs = Tables(spark, "corpus-pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return docs.orderBy("mix_position")
