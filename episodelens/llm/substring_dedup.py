"""Substring dedup by prefix-partitioned suffix trees.

Every word covered by a window of WINDOW consecutive words that also starts
anywhere else is removed; windows are judged on the input.

1. A window's anchor is its least GRAM-word gram (the leftmost of equals), which
   depends on the window's content alone, so equal windows have equal anchors
   at equal offsets.  Consecutive windows with one anchor form a block.  The
   suffixes of the trees start at anchors, and the anchor is their first prefix.
2. Anchors that occur once can't hold a repeat and leave.  Blocks of equal
   content become one suffix with their number, counted with map-side combine.
3. Suffixes of one prefix form a group.  A group of more suffixes than fit in
   memory is split: the windows that begin further left, and those that end
   further right, go on with a longer prefix each (8, 21, 28, ... words, up to
   whole windows, of which only a count is needed).  So prefixes are as long as
   their group needs, and each group is one subtree.
4. A subtree is built by sorting its suffixes by words to the right of the
   prefix; the common depths of neighbours are its internal nodes.  Suffixes
   below a node are sorted by the words to the left, which extends the node to
   the left as well: with its depth it spans a maximal repeat.  Repeats of
   WINDOW words or more give the windows to remove.

Anchors and blocks are identified by 64 and 128 bits, words in trees by 64 bits
each.  Null, empty and blank texts have no words and lose none; texts under
WINDOW words lose none; rows that repeat a doc_id or a text are separate texts
(so equal rows of WINDOW words or more lose all); an empty table gives no rows;
other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Tables, documents, hot_join, sealed
from ._text import U64, Runs, Words, batches_of, mix, window_starts

WINDOW, GRAM = 35, 8
#: Suffixes of a group that a task holds at once; of more a longer prefix is taken.
GROUP = 50_000
_BLOCK = "id long, rk long, block int, anchor long, body long"
_LEAF = "anchor long, body long, n long, before binary, after binary"


class Blocks:
    """Blocks of a slice of documents: doc, low and high (first and last window start), at (where the anchor starts), ordinal within the document, anchor and body hashes."""

    def __init__(self, words: Words, window: int = WINDOW):
        self.words = words.hashes()
        runs = Runs(self.words)
        starts, docs = window_starts(words.first, window)
        grams, _ = window_starts(words.first, GRAM)
        value = np.full(len(words) + 1, np.iinfo(np.uint64).max, np.uint64)
        value[grams] = runs.of(grams, GRAM)
        width, reach, arg = window - GRAM + 1, 1, np.arange(len(value))
        least = value
        while reach < width:  # least[p] and arg[p]: over value[p : p + reach], leftmost
            step = min(reach, width - reach)
            after, later = least[step:], arg[step:]
            take = after < least[: len(after)]
            least, arg = np.where(take, after, least[: len(after)]), np.where(take, later, arg[: len(after)])
            reach += step
        anchor = arg[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])
        at = np.flatnonzero(new)
        self.doc, self.low, self.at = docs[at], starts[at], anchor[at]
        self.high = starts[np.concatenate([at[1:], [len(starts)]])[: len(at)] - 1] if len(at) else starts
        self.first = np.searchsorted(self.doc, np.arange(len(words.first)))
        self.ordinal = np.arange(len(at)) - self.first[self.doc]
        self.anchor = value[self.at]
        self.body = runs.of(self.low, self.high - self.low + window)

    def chosen(self, lists: pa.Array, n: int) -> np.ndarray:
        """Indices of the blocks whose ordinals each of n documents lists (null: none)."""
        size = np.where(np.asarray(lists.is_valid()), np.diff(np.asarray(lists.offsets)), 0)
        return self.first[np.repeat(np.arange(n), size)] + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(window: int):
    def run(batches):
        for part, words in batches_of(batches):
            b = Blocks(words, window)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(b.doc)), part.column("rk").take(pa.array(b.doc)), pa.array(b.ordinal.astype(np.int32)), pa.array(b.anchor.view(np.int64)), pa.array(b.body.view(np.int64))], ["id", "rk", "block", "anchor", "body"])

    return run


def _suffixes(window: int):
    """One suffix for each chosen block: the words from its anchor on, and those before it, nearest first."""

    def run(batches):
        for part, words in batches_of(batches):
            b = Blocks(words, window)
            lists = part.column("blocks")
            at = b.chosen(lists, part.num_rows)
            counts = pa.array(part.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            spans = list(zip(b.low[at].tolist(), b.at[at].tolist(), (b.high[at] + window).tolist(), strict=True))
            before = [b.words[low:a][::-1].tobytes() for low, a, _ in spans]
            after = [b.words[a:end].tobytes() for _, a, end in spans]
            yield pa.RecordBatch.from_arrays([pa.array(b.anchor[at].view(np.int64)), pa.array(b.body[at].view(np.int64)), counts, pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["anchor", "body", "n", "before", "after"])

    return run


def _sequences(column: pa.Array, skip: int, width: int, salt: np.ndarray) -> np.ndarray:
    """Rows of `width` words after the first `skip` ones; beyond its end a row differs from all others."""
    blobs = column.to_pylist()
    size = np.array([len(x) for x in blobs], np.int64) // 8
    data, first = np.frombuffer(b"".join(blobs), np.uint64), np.cumsum(size) - size
    length = np.clip(size - skip, 0, width)
    place = np.arange(width)
    inside = place < length[:, None]
    out = mix(salt[:, None] + (place + 1).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    if len(data):
        out[inside] = data[((first + skip)[:, None] + place)[inside]]
    return out


def _order(*parts: np.ndarray) -> np.ndarray:
    """Sorting order of rows of words, read one after the other."""
    whole = np.ascontiguousarray(np.concatenate([p if p.ndim == 2 else p[:, None] for p in parts], 1).astype(">u8"))
    return np.argsort(whole.view(f"S{whole.shape[1] * 8}").ravel(), kind="stable") if len(whole) else np.zeros(0, np.int64)


def _common(rows: np.ndarray) -> np.ndarray:
    """Words that each row (but the last) shares with the next, from the first on."""
    return np.cumprod(rows[1:] == rows[:-1], axis=1).sum(1) if len(rows) else np.zeros(0, np.int64)


def subtrees(group: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Repeated windows of suffixes, as bits: bit t is set if another suffix of the group shares t words before and span - t after.

    group: the subtree of each suffix; before and after: span words beyond the
    common prefix to the left (nearest first) and to the right.
    """
    span = after.shape[1]
    found = np.zeros(len(group), np.int64)
    by_right = _order(group, after)
    group, before, right = group[by_right], before[by_right], after[by_right]
    depth = np.where(group[1:] == group[:-1], _common(right), -1)
    left_place = np.empty(len(group), np.int64)
    left_place[_order(before)] = np.arange(len(group))
    bits = np.zeros(len(group), np.int64)
    for d in np.unique(depth[depth >= 0]).tolist():  # the depths at which there are internal nodes
        joined = depth >= d
        inside = np.zeros(len(group), bool)
        inside[1:] |= joined
        inside[:-1] |= joined
        node = np.cumsum(np.concatenate([[True], ~joined]))
        at = np.flatnonzero(inside)
        at = at[np.lexsort((left_place[at], node[at]))]
        # below a node, neighbours by the words before share most of them
        shared = np.where(node[at][1:] == node[at][:-1], _common(before[at]), -1)
        reach = np.full(len(at), -1)
        reach[1:] = shared
        reach[:-1] = np.maximum(reach[:-1], shared)
        deep = reach >= span - d  # with its depth, a repeat of a whole window or more
        high, low = np.minimum(reach[deep], span), span - d
        bits[at[deep]] |= ((np.int64(2) << high) - 1) & ~((np.int64(1) << np.int64(low)) - 1)
    found[by_right] = bits
    return found


def _grow(window: int):
    """Suffixes in sorted groups -> (anchor, body, repeated): bits of the repeated windows, by the words between their start and the anchor."""
    names = ("cell", "low", "high", "anchor", "body", "n", "before", "after")

    def build(table: pa.Table):
        batch = table.combine_chunks().to_batches()[0]
        cell, low, high, anchor, body, n = (batch.column(c).to_numpy() for c in names[:6])
        found = np.zeros(len(cell), np.int64)
        for a, b in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):  # the few lengths of prefixes there are
            at = np.flatnonzero((low == a) & (high == b))
            salt = mix(body[at].view(np.uint64) ^ U64(a))
            before = _sequences(batch.column("before").take(pa.array(at)), a, b - a, salt)
            after = _sequences(batch.column("after").take(pa.array(at)), window - b, b - a, mix(salt))
            found[at] = subtrees(cell[at].view(np.uint64), before, after) << a
        keep = found != 0
        return pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(body[keep]), pa.array(found[keep])], ["anchor", "body", "repeated"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch]).select(list(names))
            held = new if held is None else pa.concat_tables([held, new])
            cell = held.column("cell").to_numpy()
            whole = int(np.searchsorted(cell, cell[-1]))  # the last group may go on
            if whole and held.num_rows >= GROUP // 4:
                yield build(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield build(held)

    return run


def _split(window: int):
    """Suffixes of groups that are too large, in two groups of longer prefixes each (those they have windows for)."""
    names = ("low", "high", "anchor", "body", "n", "before", "after")

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for low, high, anchor, body, n, before, after in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                least, most = window - len(after) // 8, len(before) // 8  # words between the first windows' start and the anchor
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    if least <= b and most >= a:
                        cell = hashlib.blake2b(before[: a * 8] + b"|" + after[: (window - b) * 8], digest_size=8, salt=bytes([a, b])).digest()
                        for column, value in zip(out, (int.from_bytes(cell, "little", signed=True), a, b, anchor, body, n, before if b > a else b"", after if b > a else b""), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["cell", *names])

    return run


_CELL = f"cell long, low int, high int, {_LEAF}"


def repeats(tables: Tables, leaves: DataFrame, window: int, group: int) -> DataFrame:
    """(anchor, body, repeated) of suffixes whose windows occur in other suffixes too."""
    found, cells, k = None, leaves.select(F.col("anchor").alias("cell"), F.lit(0).alias("low"), F.lit(window - GRAM).alias("high"), "*"), 0
    while True:
        many = cells.where("low < high").groupBy("cell", "low", "high").agg(F.count("*").alias("size")).where(F.col("size") > group)
        # written, so that the joins know how few they are: at most one for each `group` suffixes
        many = tables.keep(many.select("cell", "low", "high", F.lit(True).alias("large")), f"large-{k}")
        marked = cells.join(many, ["cell", "low", "high"], "left")
        small = marked.where("large is null and low < high").drop("large").repartition("cell").sortWithinPartitions("cell", "low", "high")
        part = small.mapInArrow(_grow(window), "anchor long, body long, repeated long")
        found = part if found is None else found.union(part)
        # prefixes of whole windows: a count tells
        full = cells.where("low = high")
        often = full.groupBy("cell", "low").agg(F.count("*").alias("times")).where("times > 1")
        total = full.count() if k else 0
        if total:
            found = found.union(hot_join(full, often, ["cell", "low"], "times", total).select("anchor", "body", F.expr("shiftleft(1L, low)").alias("repeated")))
        if not many.limit(1).count():
            return found
        k += 1
        cells = tables.keep(marked.where("large").drop("large", "cell").mapInArrow(_split(window), _CELL), f"cells-{k}")


def _removed(words: Words, part: pa.RecordBatch, window: int) -> np.ndarray:
    """Is each word covered by a repeated window?"""
    delta = np.zeros(len(words) + 1, np.int64)
    if part.column("_blocks").null_count < part.num_rows:
        b = Blocks(words, window)
        at = b.chosen(part.column("_blocks"), part.num_rows)
        bits = part.column("_bits").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for t in range(window - GRAM + 1):
            start = b.at[at] - t
            on = (bits >> t & 1 > 0) & (start >= b.low[at]) & (start <= b.high[at])
            np.add.at(delta, start[on], 1)
            np.add.at(delta, start[on] + window, -1)
    return np.cumsum(delta)[:-1] > 0


def kept_bytes(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each document's kept words joined by one space, and each document's bounds in them."""
    data = words.data.copy()
    at = np.flatnonzero(kept)
    doc = np.searchsorted(words.first, at, "right") - 1
    more = np.zeros(len(at), bool)
    more[:-1] = doc[1:] == doc[:-1]
    delta = np.zeros(len(data) + 1, np.int64)
    delta[words.starts[at]] += 1
    np.add.at(delta, words.ends[at], -1)
    mask = np.cumsum(delta)[:-1] > 0
    gaps = words.ends[at][more]
    data[gaps] = 0x20
    mask[gaps] = True
    total = np.concatenate([[0], np.cumsum(mask)])
    return data[mask], total[words.offsets]


def _apply(window: int, columns: list[str]):
    def run(batches):
        for part, words in batches_of(batches):
            gone = _removed(words, part, window)
            data, bounds = kept_bytes(words, ~gone)
            n = np.diff(words.first)
            lost = np.concatenate([[0], np.cumsum(gone)])
            lost = lost[words.first[1:]] - lost[words.first[:-1]]
            texts = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            sha = [hashlib.sha256(x).hexdigest() for x in texts]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha), pa.array([x.decode("utf-8", "replace") if k else None for x, k in zip(texts, lost, strict=True)], pa.string())], names=[*columns, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """docs' columns with n_words, n_removed, kept_sha256 and kept_text (null where nothing is removed).

    A column of docs that bears one of these names is replaced.
    """
    if not GRAM < window <= 60 + GRAM:
        raise ValueError(f"window must be over {GRAM} words and {60 + GRAM} at most")
    tables = Tables(docs.sparkSession, "substring-dedup")
    new = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    stay = [i for i, c in enumerate(docs.columns) if c not in new]
    docs_in, names = sealed(docs)
    columns, titles = [names[i] for i in stay], [docs.columns[i] for i in stay]
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("text").cast("string")
    keyed = docs_in.select(key.alias("id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("rk"), text.alias("text"))
    blocks = tables.keep(keyed.mapInArrow(_blocks(window), _BLOCK), "blocks")
    total = blocks.count()
    often = tables.keep(blocks.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "often")
    shared = tables.keep(hot_join(blocks, often, ["anchor"], "n", total).drop("n"), "shared")
    tables.drop("blocks")
    bodies = tables.keep(shared.groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(F.struct("id", "rk", "block")).alias("one")), "bodies")
    # a block that occurs again is repeated as a whole, and so is one whose suffix stands alone below its anchor
    whole = bodies.where("n > 1").select("anchor", "body", F.lit(-1).cast("long").alias("repeated"))
    kinds = tables.keep(bodies.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "kinds")
    mixed = hot_join(bodies, kinds, ["anchor"], "k", bodies.count())
    chosen = mixed.select("one.*", "n").groupBy("id", "rk").agg(F.collect_list(F.struct("block", "n")).alias("x")).select("id", "rk", F.col("x.block").alias("blocks"), F.col("x.n").alias("counts"))
    leaves = tables.keep(keyed.join(chosen, ["id", "rk"]).mapInArrow(_suffixes(window), _LEAF), "leaves")
    found = whole.union(repeats(tables, leaves, window, group)).groupBy("anchor", "body").agg(F.bit_or("repeated").alias("repeated"))
    found = tables.keep(found.join(bodies.select("anchor", "body", "n"), ["anchor", "body"]), "found")
    marks = hot_join(shared, found, ["anchor", "body"], "n", total).groupBy("id", "rk").agg(F.collect_list(F.struct("block", "repeated")).alias("x"))
    marks = tables.keep(marks.select(F.col("id").alias("_id"), F.col("rk").alias("_rk"), F.col("x.block").alias("_blocks"), F.col("x.repeated").alias("_bits")), "marks")
    for name in ("often", "shared", "bodies", "kinds", "leaves", "found"):
        tables.drop(name)
    full = docs_in.select(*dict.fromkeys([*columns, "doc_id", "text"])).withColumn("text", text).withColumn("_key", key).withColumn("_hash", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    joined = full.join(marks, (F.col("_key") == F.col("_id")) & (F.col("_hash") == F.col("_rk")), "left").drop("_id", "_rk", "_key", "_hash")
    kind = ", ".join(f"`{c}` {full.schema[c].dataType.simpleString()}" for c in columns)
    return joined.mapInArrow(_apply(window, columns), f"{kind}, n_words long, n_removed long, kept_sha256 string, kept_text string").toDF(*titles, *new)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
, s AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 35 THEN range(1, len(ws) - 33) ELSE []::BIGINT[] END) AS p FROM w)
, h AS (SELECT doc_id, p, md5_number(array_to_string(ws[p:p+34], ' ')) AS h FROM s)
, r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1)
, c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM h WHERE h IN (SELECT h FROM r))
, l AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM c GROUP BY doc_id)
, k AS (SELECT w.doc_id, w.ws, coalesce(l.n, 0) AS n FROM w LEFT JOIN l USING (doc_id))
, u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
, t AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id)
SELECT k.doc_id, len(k.ws)::BIGINT AS n_words, k.n::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM k LEFT JOIN t USING (doc_id)
"""
