"""Exact top-k search by tiled matrix products.

Vectors become integers, floor(64 * x).  Queries form tiles and candidates form
shards, both of bounded size; each tile meets each shard in one task, which
multiplies them.  A partial selection keeps the k best of each tile and shard,
and the lists of all shards are merged in a tree.  A stated set of queries meets
all rows in blocks: nothing passes through the driver but two counts, and memory
grows with neither side.

Products are exact: float64 while no sum can reach 2**53, Python integers
beyond; a score outside 64 bits is an error.  Vectors that are null, hold a null or a non-finite component, or have
another length than the query take no part; so do null ids.  Of rows that
repeat an id, each is a candidate and the one with the smallest vector is the
query; a query never finds rows of its own id.  An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Tables, documents

K, STEP = 20, 20
#: Bytes of a tile of queries and of a shard of candidates; candidate rows multiplied at once; lists merged by a task of the tree.
TILE_BYTES, SHARD_BYTES, SHARD_ROWS, FAN_IN = 8 << 20, 32 << 20, 4096, 16
FOUND = "query_id long, vec_id long, score decimal(38,0), part int"


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): ids and integer components (as doubles) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    ok = F.col(ident).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(ok).select(F.col(ident).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(64.0)).cast("double")).alias("x"))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in the column."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))))
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partial selection: (query row, id, score) of each row's k largest scores, ties to the smaller id; rows of the query's own id take no place.  Columns follow ascending ids."""
    others = scores.astype(float if scores.dtype != object else object)
    for i, (a, b) in enumerate(zip(np.searchsorted(ids, own), np.searchsorted(ids, own, "right"), strict=True)):
        others[i, a:b] = -np.inf
    if scores.dtype != object and scores.shape[1] > k:
        near = others >= np.partition(others, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    else:
        near = np.ones(scores.shape, bool)
    r, c = np.nonzero(near & (ids[None] != own[:, None]))
    order = _ordered(scores[r, c], r, ids=c)
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(own)))[r] < k
    r, c = r[keep], c[keep]
    return r, ids[c], scores[r, c]


def _ordered(scores: np.ndarray, *before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by `before`, falling scores and rising ids; scores may be Python integers."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (*(x[j] for x in before), -scores[j], ids[j])), int)
    return np.lexsort((ids, -scores, *reversed(before)))


def _vectors(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of each vector length, by ascending id."""
    parts: dict[int, list] = {}
    for batch in table.combine_chunks().to_batches():
        ids = batch.column("vec_id").to_numpy()
        for rows, matrix in _matrix(batch.column("x")):
            parts.setdefault(matrix.shape[1], []).append((ids[rows], matrix))
    out = {}
    for d, found in parts.items():
        ids, matrix = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(ids, kind="stable")
        out[d] = ids[order], matrix[order]
    return out


def _search(k: int):
    """The k best candidates of a shard for each query of a tile."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        queries, candidates = _vectors(left), _vectors(right)
        out: list[list[np.ndarray]] = [[], [], []]
        for d, (q_ids, q) in queries.items():
            if d not in candidates:
                continue
            ids, matrix = candidates[d]
            exact = float(np.abs(q).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(d, 1) < 2**53
            for at in range(0, len(q_ids), 512):
                block, own = q[at : at + 512], q_ids[at : at + 512]
                held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if exact else object)]
                for a in range(0, len(ids), SHARD_ROWS):
                    part = matrix[a : a + SHARD_ROWS]
                    scores = (block @ part.T).astype(np.int64) if exact else np.array([[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in part] for u in block], object)
                    r, i, s = (np.concatenate(x) for x in zip(held, best(scores, ids[a : a + SHARD_ROWS], own, k), strict=True))
                    order = _ordered(s, r, ids=i)
                    r, i, s = r[order], i[order], s[order]
                    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(own)))[r] < k
                    held = [r[keep], i[keep], s[keep]]
                for column, value in zip(out, (own[held[0]], held[1], held[2].astype(object)), strict=True):
                    column.append(value)
        ids, found, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        scores = pa.array([Decimal(int(v)) for v in scores], pa.decimal128(38, 0))
        return pa.table([pa.array(ids), pa.array(found), scores, pa.array(np.full(len(ids), key[1].as_py()), pa.int32())], ["query_id", "vec_id", "score", "part"])

    return run


def merge_tree(found: DataFrame, parts: int, k: int = K) -> DataFrame:
    """Merges the shards' lists FAN_IN at a time; every round keeps k a query and group."""
    from pyspark.sql import Window

    order = (F.col("score").desc(), F.col("vec_id"))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = found.withColumn("part", F.expr(f"int(part div {FAN_IN})"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = K, tile_bytes: int = TILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and candidates as usable() gives them."""
    tables = Tables(candidates.sparkSession, "topk")
    queries = tables.keep(queries.groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    # rows are dealt by their place, so that no id gathers its repeats in one shard
    place = F.xxhash64(F.monotonically_increasing_id())
    candidates = tables.keep(candidates.withColumn("place", place), "candidates")
    parts = lambda df, limit: max(1, -(-(df.agg(F.sum(F.size("x").cast("long") * 8 + 8)).first()[0] or 0) // limit))
    tiles, shards = parts(queries, tile_bytes), parts(candidates, shard_bytes)
    left = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "x")
    right = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "vec_id", "x")
    grid = left.groupBy("tile", "shard").cogroup(right.groupBy("tile", "shard"))
    found = tables.keep(grid.applyInArrow(_search(k), FOUND), "found")
    return merge_tree(found, shards, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(documents(spark, sf_dir, "embeddings"))
    return exact_topk(rows.where(F.col("vec_id") % STEP == 0), rows)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x))
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
