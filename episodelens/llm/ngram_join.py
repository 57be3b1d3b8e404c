"""N-gram Jaccard join by a size-aware heavy-light algorithm.

Each document becomes the set of its distinct 5-word shingles (ASCII
lower-cased; with fewer words the whole sequence is the one shingle).  Two
documents link when ``100 * |A & B| >= 75 * |A | B|``.

* Light sets (size up to a boundary) meet by enumerating all subsets of the
  size that an admissible pair must share; a shared subset links a set of the
  pair's smaller size with the others (two of the larger size may share too few).
* Heavy sets scan inverted lists: the lists of a set's rarest shingles, by the
  prefix principle (any fixed global order gives the same links; rarity only
  keeps lists short), against all sets, light ones near the boundary included.
* The boundary minimises a cost: subsets enumerated below it plus list entries
  scanned above it, from the histogram of sizes and the mean list length.

Equal sets, told by two independent hashes of 64 bits, are merged first, so a
group of exact copies costs one set.  All candidate pairs, those of shared subsets
too, are verified on whole sets.  Lists over LONG entries first link each member
with a hub, then with pivots; once the components of those links are known, only
pairs of different components are compared there, in blocks of bounded size, so
that a large group of near copies costs no quadratic work and no link between
different components is missed.  Many unlike texts that share their rarest
shingles do cost a number of comparisons that grows with their square.

Defined results: null, empty or blank text gives an empty set, n_shingles 0
and no link; rows that repeat a doc_id count as one document; a row with a null
doc_id takes no part and keeps a null component_id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Tables, components, documents, hot_join
from ._text import U64, Runs, batches_of, mix, window_starts

SHINGLE = 5
#: Slots of the frequency sketch that orders shingles; its size is fixed, so it may be broadcast.
SKETCH_BITS, SKETCH_BLOCKS = 22, 16
#: Sets up to this size may be light.
MAX_LIGHT = 12
#: Lists up to this length compare all their pairs at once.
LONG = 48
#: Entries of a block of a long list.
BLOCK = 1024
#: A bitmap of slots spares sets that are in no pair the way to disk: FILTER_SLOTS for each node, up to 2**FILTER_BITS in all,
#: so that it may be broadcast; with fewer than FILTER_LEAST for each node the sets are found by a join.
FILTER_SLOTS, FILTER_LEAST, FILTER_BITS = 256, 8, 27
#: Long lists try so many pivots a turn, with a node's so many lists, and so many turns at most,
#: each of which must halve the pairs of different components; then the remaining ones are compared.
PIVOTS, LISTS, TURNS = 32, 16, 5


def shared_size(n, m):
    """Least intersection of sets of n and m elements that link: ceil(3 (n + m) / 7)."""
    return -((n + m) * 3 // -7)


def probe_prefix(n):
    """A linked pair shares one of so many first elements of each set."""
    return n - -(n * 3 // -4) + 1


def index_prefix(n):
    """As probe_prefix, for the smaller set of the pair."""
    return n - -(n * 6 // -7) + 1


def shingle_sets(words, k: int = SHINGLE, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, second independent hash on request) of a slice of documents; sorted, distinct."""
    starts, docs = window_starts(words.first, k)
    count = np.diff(words.first)
    few = np.flatnonzero((count > 0) & (count < k))
    docs = np.concatenate([docs, few])

    def hashed(other: bool) -> np.ndarray:
        runs = Runs(words.hashes(lower=True, other=other))
        return np.concatenate([runs.of(starts, k), runs.of(words.first[:-1][few], count[few])])

    hashes = hashed(False)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new], hashed(True)[order][new] if second else hashes[:0]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _described(part, words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]:
    """Shingles of a slice by document, their bounds, set sizes, and the columns doc_id, n_shingles, sig1, sig2."""
    docs, hashes, others = shingle_sets(words, second=True)
    bounds = np.searchsorted(docs, np.arange(part.num_rows + 1))
    n = np.diff(bounds)
    return docs, hashes, bounds, [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(_sums(mix(hashes), bounds).view(np.int64)), pa.array(_sums(mix(others), bounds).view(np.int64))]


def _describe(batches):
    """Rows of documents, and at the end of the task its part of the sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for part, words in batches_of(batches):
        _, hashes, _, columns = _described(part, words)
        slots, times = np.unique(hashes >> U64(64 - SKETCH_BITS), return_counts=True)
        sketch[slots.astype(np.int64)] += times.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())], ["doc_id", "n_shingles", "sig1", "sig2", "slot", "counts"])
    blocks = np.minimum(sketch, 255).astype(np.uint8).reshape(SKETCH_BLOCKS, -1)
    used = [i for i in range(SKETCH_BLOCKS) if blocks[i].any()]
    none = pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["doc_id", "n_shingles", "sig1", "sig2", "slot", "counts"])


def _merge_sketch(batches):
    """Adds the parts of each slot block; fixed size whatever the input.

    In a large corpus each slot holds many rare shingles; the median slot tells
    how many, and what exceeds it tells frequent shingles.
    """
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, counts in zip(batch.column("slot").to_pylist(), batch.column("counts"), strict=True):
            new = np.frombuffer(counts.as_buffer(), np.uint8)
            sums.setdefault(slot, np.zeros(len(new), np.int64))
            sums[slot] += new
    for slot, total in sums.items():
        over = total - int(np.median(total))
        level = np.clip(np.where(over <= 0, 40 + over, 40 + np.floor(np.log2(1 + np.maximum(over, 0)) * 8)), 0, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([float((total.astype(float) ** 2).sum())]), pa.array([float(total.sum())])], ["slot", "levels", "squares", "total"])


def subsets_of(n: int, boundary: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) of the light pairs a set of n elements takes part in."""
    return [(min(n, m), max(n, m), int(shared_size(n, m))) for m in range(1, boundary + 1) if shared_size(n, m) <= min(n, m)]


def choose_boundary(histogram: dict[int, int], list_length: float) -> int:
    """The size boundary of least cost: subsets enumerated up to it, list entries scanned beyond it."""
    cost = lambda x: sum(c * (sum(comb(n, s) for _, _, s in subsets_of(n, x)) if n <= x else int(probe_prefix(n)) * (1 + list_length)) for n, c in histogram.items() if n <= MAX_LIGHT)
    return min(range(MAX_LIGHT + 1), key=cost)


def _prefixes(levels):
    """(doc_id, n, sig1, sig2, first): each set's elements in the global order, so many that lists are complete."""

    def run(batches):
        table = np.frombuffer(levels.value, np.uint8)
        for part, words in batches_of(batches):
            docs, hashes, bounds, columns = _described(part, words)
            n = np.diff(bounds)
            ranked = (table[(hashes >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << U64(56)) | (hashes >> U64(8))
            order = np.lexsort((ranked, docs))
            ranked = ranked[order]
            need = np.where(n <= MAX_LIGHT, n, probe_prefix(n))
            blobs = [ranked[a : a + k].tobytes() for a, k in zip(bounds[:-1], need, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], ["doc_id", "n_shingles", "sig1", "sig2", "first"])

    return run


def _postings(boundary: int):
    """(list, node, place): entries of inverted lists, place packing size and position; and enumerated subsets, place -1 for sets of the smaller size of the pair and 0 for larger ones."""

    def run(batches):
        for batch in batches:
            data, offsets = np.frombuffer(b"".join(batch.column("first").to_pylist()), np.uint64), None
            sizes, nodes = batch.column("n_shingles").to_numpy(), batch.column("node").to_numpy()
            held = np.where(sizes <= MAX_LIGHT, sizes, probe_prefix(sizes))
            offsets = np.concatenate([[0], np.cumsum(held)])
            # of light sets only those near the boundary can pair with a heavy one
            listed = np.where((sizes > boundary) | (4 * sizes >= 3 * (boundary + 1)), probe_prefix(sizes), 0)
            keys, owners, places = [], [], []
            place = np.arange(len(data)) - np.repeat(offsets[:-1], held)
            owner = np.repeat(np.arange(len(sizes)), held)
            on = place < listed[owner]
            keys.append(data[on].view(np.int64))
            owners.append(nodes[owner[on]])
            places.append((sizes[owner[on]] << 24) | np.minimum(place[on], (1 << 24) - 1))
            for i in np.flatnonzero(sizes <= boundary):
                own = [int(x) for x in np.sort(data[offsets[i] : offsets[i + 1]])]
                made = [hash((small, large, s, *chosen)) for small, large, s in subsets_of(int(sizes[i]), boundary) for chosen in combinations(own, s)]
                keys.append(np.array(made, np.int64))
                owners.append(np.full(len(made), nodes[i]))
                places.append(np.array([-1 if small == sizes[i] else 0 for small, _, s in subsets_of(int(sizes[i]), boundary) for _ in range(comb(int(sizes[i]), s))], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, owners, places)], ["list", "node", "place"])

    return run


def _admissible(small: np.ndarray, large: np.ndarray, boundary: int) -> np.ndarray:
    """May entries (places) of one list pair: sizes, prefixes and the elements left after them allow a link."""
    n, m, i, j = small >> 24, large >> 24, small & 0xFFFFFF, large & 0xFFFFFF
    return (4 * n >= 3 * m) & ((m > boundary) | (m == 0)) & ((i < index_prefix(n)) | (n == 0)) & ((np.minimum(n - i, m - j) >= shared_size(n, m)) | (n == 0))


PAIRS = "a long, b long, list long, place long"


def _scan_lists(boundary: int):
    """Streams lists sorted by (list, place, node): pairs of short ones; of long ones a hub for each member, and the entries themselves."""

    def emit(a, b):
        low, high = np.minimum(a, b), np.maximum(a, b)
        found = np.unique(np.stack([low, high], 1)[low != high], axis=0)
        none = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), none, none], ["a", "b", "list", "place"])

    def lists(keys, nodes, places):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        length = np.diff(np.concatenate([first, [len(keys)]]))
        size = np.repeat(length, length)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # enumerated subsets: all members link with the first one, if that is of the smaller size
        head = np.repeat(first, length)
        sub = np.flatnonzero((places <= 0) & (places[head] < 0) & (size > 1))
        a.append(nodes[head[sub]])
        b.append(nodes[sub])
        real = places > 0
        for step in range(1, min(LONG, int(length.max(initial=1)))):
            k = np.flatnonzero((size[:-step] <= LONG) & (size[:-step] > step) & (keys[:-step] == keys[step:]) & real[:-step])
            if not len(k):
                break
            k = k[_admissible(places[k], places[k + step], boundary)]
            a.append(nodes[k])
            b.append(nodes[k + step])
        yield emit(np.concatenate(a), np.concatenate(b))

    def long_list(key, nodes, places, hub):
        """One piece of a long list; hub: (size, node) carried over pieces."""
        n, at, a, b = places >> 24, 0, [], []
        while at < len(n):
            if hub is None or 4 * hub[0] < 3 * n[at]:
                hub = (int(n[at]), int(nodes[at]))
            to = int(np.searchsorted(n, hub[0] * 4 // 3, "right"))
            a.append(np.full(to - at, hub[1]))
            b.append(nodes[at:to])
            at = to
        yield emit(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(n), pa.int64()), pa.array(np.full(len(n), key)), pa.array(places)], ["a", "b", "list", "place"])
        return hub

    def run(batches):
        held, open_list, hub = [np.zeros(0, np.int64)] * 3, None, None
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("list", "node", "place"), strict=True)]
            while len(held[0]):
                if open_list is not None:
                    k = int(np.searchsorted(held[0] != open_list, True))
                    if k:
                        hub = yield from long_list(open_list, held[1][:k], held[2][:k], hub)
                    held = [h[k:] for h in held]
                    if not len(held[0]):
                        break
                    open_list = hub = None
                last = int(np.searchsorted(held[0], held[0][-1]))
                first = np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))
                length = np.diff(np.concatenate([first, [len(held[0])]]))
                # long lists of sets leave the stream one by one; the last list may go on
                for i in np.flatnonzero((length > LONG) & (held[2][first] > 0)):
                    x = slice(first[i], first[i] + length[i])
                    got = yield from long_list(int(held[0][first[i]]), held[1][x], held[2][x], None)
                    if i == len(first) - 1:
                        open_list, hub = int(held[0][-1]), got
                whole = ~np.repeat((length > LONG) & (held[2][first] > 0), length)
                if open_list is None and len(held[0]) - last <= LONG:
                    whole[last:] = False
                if whole.any():
                    yield from lists(*(h[whole] for h in held))
                # of a long list of a shared subset, which may go on, the first entry stays: later ones link with it
                keep = slice(0, 0) if open_list is not None else slice(last, None if len(held[0]) - last <= LONG else last + 1)
                held = [h[keep] for h in held]
                break
        if len(held[0]):
            yield from lists(*held)

    return run


def _block_pairs(boundary: int):
    """Pairs of different components in one pair of blocks of a long list."""

    def group(rows):
        block, node, place, label = rows
        order = np.lexsort((node, place))
        block, node, place, label = block[order], node[order], place[order], label[order]
        for i in range(len(node) - 1):
            rest = slice(i + 1, len(node))
            k = np.flatnonzero((label[rest] != label[i]) & _admissible(np.full(len(node) - i - 1, place[i]), place[rest], boundary)) + i + 1
            if len(k):
                yield np.minimum(node[i], node[k]), np.maximum(node[i], node[k])

    def run(batches):
        held = None
        names = ("list", "one", "two", "node", "place", "label")

        def cut(held, last):
            key = np.stack(held[:3])
            first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            ends = np.concatenate([first[1:], [key.shape[1]]])
            take = len(first) if last else len(first) - 1
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(first[:take], ends[:take], strict=True):
                for x, y in group((held[1][s:e], held[3][s:e], held[4][s:e], held[5][s:e])):
                    a.append(x)
                    b.append(y)
            found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            rest = [h[first[take] :] if take < len(first) else h[:0] for h in held]
            return rest, pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in names]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            held, out = cut(held, False)
            yield out
        if held is not None and len(held[0]):
            yield cut(held, True)[1]

    return run


def _slot_map(nodes: DataFrame, slots: int) -> np.ndarray:
    """Bitmap of hash slots that hold a node."""
    slot = F.pmod(F.xxhash64("node"), F.lit(slots))
    words = nodes.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(xxhash64(node), {slots}L) & 63))")).alias("bits"))
    out = np.zeros(slots >> 6, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("w").to_numpy()] = batch.column("bits").to_numpy()
    return out


def _sets(taken):
    """Sets of the documents whose slot is taken (all, without a bitmap); those of others are left out early, some too many do no harm."""

    def run(batches):
        bits = None if taken is None else np.frombuffer(taken.value, np.uint8)
        for batch in batches:
            if bits is not None:
                slot = batch.column("slot").to_numpy()
                batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            for part, words in batches_of([batch]):
                docs, hashes, _ = shingle_sets(words)
                bounds = np.searchsorted(docs, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["node", "elements"])

    return run


def _paired_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, elements) of the nodes, and of some others."""
    spark = texts.sparkSession
    known = texts.where("doc_id is not null")
    n = nodes.agg(F.approx_count_distinct("node")).first()[0]
    bits = min(FILTER_BITS, max(16, (n * FILTER_SLOTS - 1).bit_length()))
    if n * FILTER_LEAST > 1 << bits:
        found = known.join(nodes.distinct().withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
        return found.mapInArrow(_sets(None), "node long, elements binary")
    taken = spark.sparkContext.broadcast(_slot_map(nodes, 1 << bits).tobytes())
    return known.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))).mapInArrow(_sets(taken), "node long, elements binary")


def _verify(batches):
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
            keep[i] = both > 0 and 100 * both >= 75 * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _links(tables: Tables, sets: DataFrame, pairs: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Those of pairs (a, b) whose sets link; few: most sets are in no pair and needn't be shuffled."""
    side = lambda end, name: sets.select(F.col("node").alias(end), F.col("elements").alias(name))
    xs, ys = (s.join(pairs.select(end).distinct(), end, "left_semi") if few else s for s, end in ((side("a", "x"), "a"), (side("b", "y"), "b")))
    both = pairs.join(xs, "a").join(ys, "b").select("a", "b", "x", "y")
    # few rows are left of much read: a shuffle of them spares one small file for each task
    return tables.keep(both.mapInArrow(_verify, "a long, b long").repartition("a", "b"), f"{name}-links")


def _joined(tables: Tables, label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(node, label) after more links: components of the graph whose nodes are the components so far, far fewer than nodes."""
    start, end = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    ends = links.join(start, "a", "left").join(end, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = components(tables, ends.where("a <> b"), name)
    new = over.select("node", F.col("node").alias("label")).join(label, "node", "left_anti")
    moved = label.union(new).join(over.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return tables.keep(moved.select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels")


def _open_lists(entries: DataFrame) -> tuple[DataFrame, int, int]:
    """Lists that hold several components, the number of pairs of different components in them, and of entries."""
    sizes = entries.groupBy("list", "label").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("list").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("inside"), F.count("*").alias("labels")).where("labels > 1")
    cost = lists.agg(F.coalesce(F.sum((F.col("n").cast("double") * F.col("n") - F.col("inside")) / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return lists.select("list", F.expr(f"int(ceil(n / {BLOCK}))").alias("blocks")), int(cost[0]), int(cost[1])


def _pivot_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """Pairs of each entry of a long list with the list's pivots of other components: as many rows as nodes times LISTS * PIVOTS at most.

    Pivots only bring components together; the pairs left are all compared later.
    An entry whose list comes late in a set leaves too few elements for a link and makes no pair.
    """
    chance = F.xxhash64(F.col("list"), F.lit(turn))
    few = entries.groupBy("node", "label", F.pmod(F.xxhash64("list"), F.lit(LISTS)).alias("slot")).agg(F.min(F.struct(chance.alias("chance"), "list", "place")).alias("e"))
    entries = few.select("node", "label", "e.list", "e.place")
    order = F.xxhash64(F.col("node"), F.lit(turn))
    pivots = entries.groupBy("list", F.pmod(order, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(order.alias("order"), "node", "place", "label")).alias("p"))
    size, other = F.shiftright("place", 24), F.shiftright("p.place", 24)
    left, others = size - F.col("place").bitwiseAND(0xFFFFFF), other - F.col("p.place").bitwiseAND(0xFFFFFF)
    apart = (F.col("label") != F.col("p.label")) & (4 * size >= 3 * other) & (4 * other >= 3 * size) & (7 * F.least(left, others) >= 3 * (size + other))
    near = entries.join(pivots.select("list", "p").withColumnRenamed("list", "l"), (F.col("list") == F.col("l")) & apart)
    return near.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Links inside a component that add nothing to it aren't expanded, so their
    number isn't known.
    """
    tables = Tables(spark, "ngram-join")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = tables.keep(texts.mapInArrow(_describe, "doc_id long, n_shingles long, sig1 long, sig2 long, slot int, counts binary"), "described", few=["doc_id", "slot"])
    rows = seen.where("slot is null").select("doc_id", "n_shingles", "sig1", "sig2")
    merged = seen.where("slot is not null").select("slot", "counts").repartition(SKETCH_BLOCKS, "slot").mapInArrow(_merge_sketch, "slot int, levels binary, squares double, total double").collect()
    levels, squares, total = bytearray(1 << SKETCH_BITS), 0.0, 1.0
    for part in merged:  # SKETCH_BLOCKS rows of fixed size
        step = (1 << SKETCH_BITS) // SKETCH_BLOCKS
        levels[part.slot * step : (part.slot + 1) * step] = part.levels
        squares, total = squares + part.squares, total + part.total
    histogram = {r.n_shingles: r["count"] for r in rows.where(F.col("n_shingles").between(1, MAX_LIGHT)).groupBy("n_shingles").count().collect()}
    boundary = choose_boundary(histogram, max(0.0, squares / total - total / (1 << SKETCH_BITS)))
    shared = spark.sparkContext.broadcast(bytes(levels))
    sets = texts.where("doc_id is not null").mapInArrow(_prefixes(shared), "doc_id long, n_shingles long, sig1 long, sig2 long, first binary").where("n_shingles > 0")
    merged_sets = sets.groupBy("sig1", "sig2", "n_shingles").agg(F.min(F.struct("doc_id", "first")).alias("x")).select(F.col("x.doc_id").alias("node"), "n_shingles", "x.first")
    postings = merged_sets.mapInArrow(_postings(boundary), "list long, node long, place long")
    scanned = tables.keep(postings.repartition("list").sortWithinPartitions("list", "place", "node").mapInArrow(_scan_lists(boundary), PAIRS), "scanned", few=["a", "b"])
    pairs = tables.keep(scanned.where("list is null").select("a", "b").distinct(), "pairs")
    entries = scanned.where("list is not null").select("list", F.col("a").alias("node"), "place")
    # sets of all entries of long lists too: pivots and blocks pair nodes that are in no pair so far
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(entries.select("node"))
    sets = tables.keep(_paired_sets(texts, nodes), "sets", few=["node"])
    links = _links(tables, sets, pairs, "first")
    tested, turn, before = pairs, 0, float("inf")
    label = components(tables, links, "cc")
    while entries.limit(1).count():
        labelled = tables.keep(entries.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), f"labelled-{turn}")
        lists, cost, n = _open_lists(labelled)
        labelled = labelled.join(lists, "list")
        if not cost:
            break
        # no more pairs an entry than short lists have are all compared, and any number once a turn doesn't halve them
        if last := cost <= n * (LONG // 2) or 2 * cost > before or turn == TURNS:
            spread = labelled.withColumn("block", F.expr("int(pmod(xxhash64(node), blocks))")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            spread = spread.select("list", F.least("block", "other").cast("long").alias("one"), F.greatest("block", "other").cast("long").alias("two"), "node", "place", "label")
            more = spread.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two").mapInArrow(_block_pairs(boundary), "a long, b long").distinct()
        else:
            more = _pivot_pairs(labelled, turn)
        more = tables.keep(more.join(tested, ["a", "b"], "left_anti"), f"more-{turn}")
        fresh = _links(tables, sets, more, f"more-{turn}", few=True)
        tested, label = tested.union(more), _joined(tables, label, fresh, f"cc-{turn}")
        if last:
            break
        turn, before = turn + 1, cost
    copies = rows.where("n_shingles > 0 and doc_id is not null").groupBy("sig1", "sig2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("total"))
    classes = copies.join(label, "node", "left").select("sig1", "sig2", "n_shingles", "total", F.coalesce("label", "node").alias("component_id"))
    classes = tables.keep(classes, "classes")
    joined = hot_join(rows.where("n_shingles > 0 and doc_id is not null"), classes, ["sig1", "sig2", "n_shingles"], "total", rows.count()).select("doc_id", "n_shingles", "component_id")
    return joined.union(rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark, documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), hashed AS (SELECT doc_id, md5_number(s) AS s FROM g
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM hashed a JOIN hashed b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""
