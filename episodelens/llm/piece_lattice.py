"""SentencePiece encoding and decoding with N-best segmentation.

A text is normalised as the model asks (spaces become U+2581, one more in
front), and its lattice holds every vocabulary piece at every place, scored by
the model file.  Forward Viterbi scores the lattice; they are exact heuristics
of a backward A-star search that pops segmentations in order of score.

No piece crosses from a word into the next U+2581, so the lattice is a chain of
word lattices.  Words are scored once for each distinct word of a slice, in
numpy; a text's N best differ from its best one in the N - 1 words with the
least loss at most, so the search runs on those words and their segmentations
are combined best-first.  The result is the N best of the whole lattice.

Ties prefer the segmentation whose last piece is longer, then the one before,
and so on; across words, changes to earlier words come last.  Characters
outside the vocabulary are spelled as byte pieces, at UNK_PENALTY below the
least score.  Null texts give null lists; an empty text has no pieces; a text
holding U+2581 decodes with a space there; damaged UTF-8 counts as U+FFFD and
changes no other text's result.  Repeated rows are encoded each; an empty table
gives no rows; other columns pass through, whatever their names.  The vocabulary
is read from model_path and never trained.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import cache
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, sealed
from ._text import U64, Runs, repaired, slices, string_buffers

SPACE = 0x2581
NBEST, UNK_PENALTY = 4, 10
#: Bytes of text whose words share a lattice; its arrays take some hundred times as much per distinct word.
SLICE_BYTES = 1 << 19
#: Words a process remembers before it starts anew.
WORDS = 400_000
_LOW = -(2**60)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces by hash of their code points, with integer scores (the model's, times 1000)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, np.int64)
        normal = [i for i, s in enumerate(scores) if s is not None]
        self.score = np.full(len(pieces), _LOW, np.int64)
        self.score[normal] = [round(scores[i] * 1000) for i in normal]
        self.unk = int(self.score[normal].min()) - UNK_PENALTY * 1000
        self.longest = max(len(pieces[i]) for i in normal)
        if self.longest > 32 or any(chr(SPACE) in pieces[i].lstrip(chr(SPACE)) for i in normal):
            raise ValueError("a piece is over 32 characters or crosses a word boundary")
        keys = np.concatenate([Runs(np.frombuffer(pieces[i].encode("utf-32-le"), np.uint32).astype(np.uint64) + U64(1)).of(np.array([0]), len(pieces[i])) for i in normal])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal)[order]
        bits = 20
        self.shift, self.slot = U64(64 - bits), np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << U64(64 - bits))
        self.probes = int(np.bincount((self.keys >> self.shift).astype(np.int64)).max())
        text = [b"" if s is None and i not in set(byte_ids) else bytes([byte_ids.index(i)]) if i in set(byte_ids) else pieces[i].replace(chr(SPACE), " ").encode() for i, s in enumerate(scores)]
        self.bytes, self.bounds = np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])

    @property
    def known(self) -> Known:
        if "_known" not in self.__dict__:
            self._known = Known()
        return self._known

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        return cls([m.id_to_piece(i) for i in range(n)], [None if special[i] else m.get_score(i) for i in range(n)], [i for i in range(n) if m.is_byte(i)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        at = self.slot[(keys >> self.shift).astype(np.int64)]
        found = np.full(len(keys), -1, np.int64)
        for k in range(self.probes):
            here = np.minimum(at + k, len(self.keys) - 1)
            hit = self.keys[here] == keys
            found[hit] = self.ids[here[hit]]
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of pieces, without the space in front."""
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        size = self.bounds[ids + 1] - self.bounds[ids]
        at = np.repeat(self.bounds[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        data, ends = self.bytes[at].tobytes(), np.concatenate([[0], np.cumsum(size)])[first]
        return [data[a + (b > a and data[a] == 32) : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Lattice:
    """Lattices of words side by side: code points, word bounds, edges and Viterbi scores."""

    def __init__(self, v: Vocabulary, codes: np.ndarray, bounds: np.ndarray):
        self.v, self.codes, self.bounds = v, codes, bounds
        runs, n = Runs(codes.astype(np.uint64) + U64(1)), len(codes)
        length = np.diff(bounds)
        word = np.repeat(np.arange(len(length)), length)
        place = np.arange(n) - bounds[:-1][word]  # of the character in its word
        # ids[i, l]: the piece of l + 1 characters that ends with character i; -2: a character to be spelled in bytes
        self.ids = np.full((n, min(v.longest, int(length.max(initial=1)))), -1, np.int32)
        for k in range(self.ids.shape[1]):
            at = np.flatnonzero(place >= k) if k else np.arange(n)
            self.ids[at, k] = v.find(runs.of(at - k, k + 1))
        self.ids[self.ids[:, 0] < 0, 0] = -2
        # edges in order of their last character, shorter pieces first; a word of n characters has n + 1 nodes
        self.end, self.kind = np.nonzero(self.ids != -1)
        own = self.ids[self.end, self.kind]
        self.cost = np.where(own == -2, v.unk, v.score[own])
        self.node = bounds[:-1] + np.arange(len(length))
        self.to = self.end + word[self.end] + 1
        self.source = self.to - self.kind - 1
        self.forward, self.back = np.zeros(n + len(length), np.int64), np.zeros(n + len(length), np.int64)
        for at, group in self._steps(place[self.end], self.to):
            # the score decides, then the longer piece
            best = np.maximum.reduceat((self.forward[self.source[at]] + self.cost[at]) * 32 + self.kind[at], group)
            nodes = self.to[at[group]]
            self.forward[nodes], self.back[nodes] = best >> 5, (best & 31) + 1
        self.backward = np.zeros(n + len(length), np.int64)
        by_source = np.argsort(self.source, kind="stable")
        left = (self.node + length)[word[self.end]] - self.source
        for at, group in self._steps(left[by_source], self.source[by_source]):
            at = by_source[at]
            self.backward[self.source[at[group]]] = np.maximum.reduceat(self.backward[self.to[at]] + self.cost[at], group)
        self.best = self.forward[self.node + length]

    @staticmethod
    def _steps(stage: np.ndarray, key: np.ndarray):
        """Edges stage by stage, with the places where a new key begins; edges come grouped by key."""
        order = np.argsort(stage.astype(np.int16) if len(stage) and stage.max() < 2**15 else stage, kind="stable")
        cuts = np.flatnonzero(np.diff(stage[order])) + 1
        for at in np.split(order, cuts) if len(order) else ():
            yield at, np.concatenate([[0], np.flatnonzero(np.diff(key[at])) + 1])

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentation of all words: ids, each word's bounds in them, and each word's loss of its second best."""
        length = np.diff(self.bounds)
        used = np.zeros(len(self.codes) + len(length), np.int64)  # length of the piece of the best path that ends at a node
        at, word = length.copy(), np.arange(len(length))
        while len(word):
            keep = at > 0
            word, at = word[keep], at[keep]
            k = self.back[self.node[word] + at]
            used[self.node[word] + at] = k
            at = at - k
        on = used[self.to] == self.kind + 1
        owner = np.searchsorted(self.bounds, self.end, "right") - 1
        through = self.forward[self.source] + self.cost + self.backward[self.to]
        through[on] = 4 * _LOW
        first = np.searchsorted(owner, np.arange(len(length)))
        second = np.maximum.reduceat(through, first) if len(length) else through
        loss = np.where(second > 2 * _LOW, self.best - second, 2**62)
        end, word = self.end[on], owner[on]
        ids = self.ids[end, self.kind[on]].astype(np.int64)
        spelled = np.flatnonzero(ids == -2)
        count = np.ones(len(ids), np.int64)
        if len(spelled):
            raw = [np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8) for c in self.codes[end[spelled]]]
            count[spelled] = [len(x) for x in raw]
            out = np.repeat(ids, count)
            out[out == -2] = self.v.byte_ids[np.concatenate(raw)]
            ids, word = out, np.repeat(word, count)
        return ids, np.searchsorted(word, np.arange(len(length) + 1)), loss

    def nbest(self, word: int, n: int = NBEST) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids) of a word: A-star from its end, with forward scores as heuristic."""
        start, node, size = int(self.bounds[word]), int(self.node[word]), int(self.bounds[word + 1] - self.bounds[word])
        heap, out = [(-int(self.best[word]), (), size, 0)], []
        while heap and len(out) < n:
            _, path, at, g = heapq.heappop(heap)
            if not at:
                out.append((g, self._spell(start, size, path)))
                continue
            row = self.ids[start + at - 1]
            for k in np.flatnonzero(row[:at] != -1).tolist():
                score = g + (self.v.unk if row[k] == -2 else int(self.v.score[row[k]]))
                heapq.heappush(heap, (-(score + int(self.forward[node + at - k - 1])), (*path, -(k + 1)), at - k - 1, score))
        return out

    def _spell(self, start: int, size: int, path: tuple[int, ...]) -> tuple[int, ...]:
        ids, at = [], start + size
        for k in path:
            i = int(self.ids[at - 1, -k - 1])
            ids.append([i] if i >= 0 else [int(self.v.byte_ids[b]) for b in chr(int(self.codes[at - 1])).encode("utf-8", "replace")])
            at += k
        return tuple(x for part in reversed(ids) for x in part)


def words_of(text: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of normalised texts (whole UTF-8, as repaired() gives it), bounds of their words, and each document's first word."""
    codes = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    first = heads[bounds]
    full = np.diff(first) > 0
    codes = np.insert(np.where(codes == 32, SPACE, codes), first[:-1][full], SPACE)
    first = first + np.concatenate([[0], np.cumsum(full)])
    gap = codes == SPACE
    begins = gap.copy()
    begins[1:] &= ~gap[:-1]
    begins[first[:-1][full]] = True
    starts = np.flatnonzero(begins)
    return codes, np.concatenate([starts, [len(codes)]]), np.searchsorted(starts, first)


class Known:
    """Best segmentations of words a process has met, up to WORDS of them; and n best ones of those that were searched."""

    def __init__(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.start, self.count, self.best, self.loss = ([np.zeros(0, np.int64)] * 5)
        self.searched: dict[int, list] = {}

    def look_up(self, v: Vocabulary, keys: np.ndarray, words) -> np.ndarray:
        """Entries of the words of these distinct, ascending keys; words(i) gives code points and bounds of some of them."""
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        if len(self.keys):
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        entry = np.empty(len(keys), np.int64)
        entry[hit] = self.entry[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            lattice = Lattice(v, *words(new))
            ids, bounds, loss = lattice.pieces()
            entry[new] = len(self.start) + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.ids) + bounds[:-1]])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, np.diff(bounds)])
            self.best, self.loss = np.concatenate([self.best, lattice.best]), np.concatenate([self.loss, loss])
            self.keys, self.entry = np.insert(self.keys, at[new], keys[new]), np.insert(self.entry, at[new], entry[new])
        return entry

    def trim(self) -> None:
        """Forgets all when there is too much, between slices."""
        if len(self.keys) > WORDS:
            self.__init__()


@cache
def _ranks(words: int, n: int) -> list[tuple[int, ...]]:
    return [p for p in product(range(n), repeat=words) if prod(j + 1 for j in p) <= n]


def encode_slice(v: Vocabulary, text: bytes, bounds: np.ndarray, n: int = NBEST) -> list[list[tuple[int, np.ndarray]]]:
    """The n best (score, ids) of each document of a slice, best first; an empty document has none."""
    codes, words, first = words_of(text, bounds)
    if not len(codes):
        return [[] for _ in bounds[:-1]]
    keys = Runs(codes.astype(np.uint64) + U64(1)).of(words[:-1], np.diff(words))
    distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)

    def some(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (words[1:] - words[:-1])[sample[i]]
        own = np.concatenate([[0], np.cumsum(size)])
        return codes[np.repeat(words[:-1][sample[i]] - own[:-1], size) + np.arange(own[-1])], own

    known = v.known
    entry = known.look_up(v, distinct, some)
    which_entry = entry[which]
    count = known.count[which_entry]
    flat = known.ids[np.repeat(known.start[which_entry] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    place = np.concatenate([[0], np.cumsum(count)])
    score, losses = np.concatenate([[0], np.cumsum(known.best[which_entry])]), known.loss[which_entry]
    near_words = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        k = min(n - 1, b - a)
        near_words.append(np.sort(np.argpartition(losses[a:b], k - 1)[:k]) if 0 < k < b - a else np.arange(k))
    wanted = np.unique(np.concatenate([which[a + w] for a, w in zip(first[:-1], near_words, strict=True)]))
    wanted = np.array([u for u in wanted.tolist() if (int(distinct[u]), n) not in known.searched], np.int64)
    if len(wanted):
        lattice = Lattice(v, *some(wanted))
        for i, u in enumerate(wanted.tolist()):
            known.searched[int(distinct[u]), n] = lattice.nbest(i, n)
    out = []
    for a, b, near in zip(first[:-1], first[1:], near_words, strict=True):
        if a == b:
            out.append([])
            continue
        total, whole = int(score[b] - score[a]), flat[place[a] : place[b]]
        options = []
        for w in near:
            u = which[a + w]
            options.append([(int(known.best[entry[u]]) - s, j, x) for j, (s, x) in enumerate(known.searched[int(distinct[u]), n])])
        # of two combinations, one that is nowhere worse comes first: ranks whose product is over n can't be among the n best
        picks = [[o[j] for o, j in zip(options, pick, strict=True)] for pick in _ranks(len(options), n) if all(j < len(o) for o, j in zip(options, pick, strict=True))]
        combos = sorted(picks, key=lambda c: (sum(x[0] for x in c), tuple(x[1] for x in reversed(c))))[:n]
        best = [(total, whole)]
        for c in combos[1:]:
            parts, done = [], 0
            for w, (_, _, x) in zip(near, c, strict=True):
                parts += [whole[done : place[a + w] - place[a]], np.array(x, np.int64)]
                done = place[a + w + 1] - place[a]
            best.append((total - sum(x[0] for x in c), np.concatenate([*parts, whole[done:]])))
        out.append(best)
    known.trim()
    return out


def encode(docs: DataFrame, model_path: str | None = None, n: int = NBEST, keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """docs with piece_ids (null unless keep_ids), n_pieces, ids_md5 (of little-endian int32), score, nbest (score, n_pieces, ids_md5), decoded_ok.

    Columns of docs with these names are replaced.
    """
    new = ["piece_ids", "n_pieces", "ids_md5", "score", "nbest", "decoded_ok"]
    stay = [i for i, c in enumerate(docs.columns) if c not in new and (keep_text or c != "text")]
    rows, names = sealed(docs, ("text",))
    columns, titles = [names[i] for i in stay], [docs.columns[i] for i in stay]
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path or default_model()))
    digest = lambda ids: hashlib.md5(ids.astype("<i4").tobytes()).hexdigest()
    best_type = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_md5", pa.string())]))

    def run(batches):
        v = vocabulary.value
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, SLICE_BYTES):
                raw, bounds = repaired(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = raw.tobytes()
                found = encode_slice(v, raw, bounds, n)
                ids = [x[0][1] if x else np.zeros(0, np.int64) for x in found]
                texts = v.decode_all(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))
                ok = [t == raw[i:j].decode().replace(chr(SPACE), " ").encode() for t, i, j in zip(texts, bounds[:-1], bounds[1:], strict=True)]
                gone = null[a:b]
                part = batch.slice(a, b - a)
                lists = pa.array([None if g or not keep_ids else x.astype(np.int32) for x, g in zip(ids, gone, strict=True)], pa.list_(pa.int32()))
                best = pa.array([None if g else [{"score": s / 1000, "n_pieces": len(x), "ids_md5": digest(x)} for s, x in f] for f, g in zip(found, gone, strict=True)], best_type)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists, pa.array([None if g else len(x) for x, g in zip(ids, gone, strict=True)], pa.int64()), pa.array([None if g else digest(x) for x, g in zip(ids, gone, strict=True)], pa.string()), pa.array([None if g else (f[0][0] / 1000 if f else 0.0) for f, g in zip(found, gone, strict=True)], pa.float64()), best, pa.array([None if g else o for o, g in zip(ok, gone, strict=True)], pa.bool_())], names=[*columns, *new])

    full = rows.select(*dict.fromkeys([*columns, "text"])).withColumn("text", F.col("text").cast("string"))
    kind = "".join(f"`{c}` {full.schema[c].dataType.simpleString()}, " for c in columns)
    return full.mapInArrow(run, f"{kind}piece_ids array<int>, n_pieces long, ids_md5 string, score double, nbest array<struct<score: double, n_pieces: bigint, ids_md5: string>>, decoded_ok boolean").toDF(*titles, *new)


def decode(pieces: DataFrame, model_path: str | None = None, ids: str = "piece_ids") -> DataFrame:
    """pieces with decoded: the text of the list of ids; null for null, and ids outside the vocabulary decode to nothing."""
    vocabulary = pieces.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path or default_model()))

    def run(batches):
        v = vocabulary.value
        for batch in batches:
            lists = [None if x is None else np.array([i for i in x if i is not None and 0 <= i < len(v.pieces)], np.int64) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else v.decode(x).decode("utf-8", "replace") for x in lists], pa.string())], names=[*batch.schema.names, "decoded"])

    base = pieces.drop("decoded")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{kind}, decoded string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = encode(docs, keep_ids=False, keep_text=False).select("doc_id", "n_pieces", "ids_md5", "score", "nbest", "decoded_ok")
    return out.select("doc_id", "n_pieces", "ids_md5", "score", F.transform("nbest", lambda x: x["score"]).alias("nbest_scores"), "decoded_ok")
