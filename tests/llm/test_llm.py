"""Operators against brute force, round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("episodelens.llm.registry")
from episodelens.llm import _shared, language_id, ngram_join, piece_lattice, quality_rank, quality_rules, source_mixing, substring_dedup, topk_search, toxicity_mil, warc_archive  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", lambda i: "en")(i), f"s{(i or 0) % 3}", len(t or ""), "clash", "clash") for i, t in (texts if texts and isinstance(texts[0], tuple) else enumerate(texts))]
    return spark.createDataFrame(rows, KIND)


def corpus(seed=0, n=60):
    """Texts with near copies of several degrees, exact copies, shared passages, short, empty and null ones."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 5)))
    passage = [word() for _ in range(45)]
    out = []
    for _ in range(n // 6):
        base = [word() for _ in range(int(rng.integers(2, 90)))]
        out.append(" ".join(base))
        for edits in (0, 1, 2):
            copy = list(base)
            for _ in range(edits):
                copy[int(rng.integers(len(copy)))] = word()
            out.append(" ".join(copy).upper() if edits == 1 else "\n".join([" ".join(copy)]))
        out.append(" ".join([word() for _ in range(10)] + passage + [word() for _ in range(5)]))
        out.append(" ".join(base[: int(rng.integers(1, 6))]))
    return [*out, "", None, "  \t\n", "one", "one", "x " * 400, "a b c d", "A b\nC d", " ".join(passage * 2)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("long", "bits"), [(48, 27), (3, 27), (48, 8)])
def test_join_is_exact(spark, monkeypatch, long, bits):
    """Long and short lists; sets found by a bitmap and, where that would be too large, by a join."""
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = list(enumerate(corpus()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark, docs(spark, rows)).collect()}
    assert got == brute_join(rows)


def test_join_of_many_near_copies(spark, monkeypatch):
    """A group in which not all pairs link, over several blocks and turns."""
    monkeypatch.setattr(ngram_join, "LONG", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "TURNS", 1)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for k in rng.choice(60, 2, replace=False):
            copy[k] = f"v{rng.integers(9)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark, docs(spark, rows)).collect()}
    assert got == brute_join(rows)


def scanned_pairs(sets, boundary, batch_rows=10_000):
    """Pairs (a, b) that the lists of sets give, streamed in batches of so many rows."""
    blobs = [np.array(sorted(x), np.uint64).tobytes() for x in sets]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(blobs, pa.binary())], ["node", "n_shingles", "first"])
    entries = pa.Table.from_batches(ngram_join._postings(boundary)([rows])).sort_by([("list", "ascending"), ("place", "ascending"), ("node", "ascending")])
    found = pa.Table.from_batches(ngram_join._scan_lists(boundary)(entries.combine_chunks().to_batches(batch_rows))).to_pylist()
    return {(r["a"], r["b"]) for r in found if r["list"] is None}


@pytest.mark.parametrize("boundary", range(1, 13))
def test_shared_subsets_are_links(boundary):
    """Sets that differ in one or two elements, with and without a smaller set that shares the rest."""
    link = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    for n in range(2, 13):
        for smaller in (False, True):
            sets = [set(range(1, n)) | {100 + i} for i in range(3)] + [set(range(1, n - 1)) | {200, 201}] + [set(range(1, n))] * smaller
            pairs = scanned_pairs(sets, boundary)
            if n <= boundary:  # pairs of shared subsets alone: all are links
                assert all(link(sets[a], sets[b]) for a, b in pairs if max(len(sets[a]), len(sets[b])) <= boundary and 4 * max(len(sets[a]), len(sets[b])) < 3 * (boundary + 1))
            root = list(range(len(sets)))
            for a, b in pairs:
                if link(sets[a], sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
            assert all(root[a] == root[b] for a in range(len(sets)) for b in range(a) if link(sets[a], sets[b]))


@pytest.mark.parametrize("batch_rows", [60, 64, 100, 131, 10_000])
def test_shared_subset_over_batches(batch_rows):
    """Lists of shared subsets longer than a batch, with and without a smaller set, keep their members together."""
    for sets in ([set(range(1, 9)) | {100 + i} for i in range(400)], [set(range(1, 9)), *(set(range(1, 9)) | {100 + i, 500 + i} for i in range(300))]):
        root = list(range(len(sets)))
        for a, b in scanned_pairs(sets, 12, batch_rows):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        assert set(root) == {0}


def test_join_of_short_texts(spark, monkeypatch):
    """Texts of 8 to 13 words that differ in the last one, at a boundary that takes all as light."""
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda *_: 12)
    rows = list(enumerate(" ".join([f"{n}x{i}" for i in range(n - 1)] + [end]) for n in range(8, 14) for end in ("y", "z")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark, docs(spark, rows)).collect()}
    assert got == brute_join(rows)


def test_join_with_a_hub_of_its_own(spark):
    """In its long lists the largest set follows a set too small for it, so that it opens a hub after which nobody comes."""
    base = [f"w{i}" for i in range(124)]
    texts = [[*base, f"v{i}"] for i in range(60)] + [base[20:], base[:-20], base + [f"u{i}" for i in range(14)]]
    rows = list(enumerate(" ".join(t) for t in texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark, docs(spark, rows)).collect()}
    assert ngram_join.LONG == 48 and got[62] == (134, 0) and got == brute_join(rows)


def test_join_edges(spark):
    assert ngram_join.ngram_jaccard_join(spark, docs(spark, []).limit(0)).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (2, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark, docs(spark, rows)).collect())
    assert got == [(-1, 2, None), (2, 0, 2), (4, 2, 4), (9, 2, 4), (9, 2, 4)]


def test_light_pairs_cover_all_links():
    """Whatever the boundary: admissible sizes share a subset or meet in prefixes."""
    for n in range(1, 13):
        for m in range(n, 17):
            if 4 * n >= 3 * m:
                assert ngram_join.shared_size(n, m) <= n and 100 * ngram_join.shared_size(n, m) >= 75 * (n + m - ngram_join.shared_size(n, m))
                assert ngram_join.index_prefix(n) > n - ngram_join.shared_size(n, m) and ngram_join.probe_prefix(m) > m - ngram_join.shared_size(n, m)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (31, 30), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in _shared.components(_shared.Tables(spark, "t"), edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30}


@pytest.mark.parametrize("group", [200_000, 3, 1])
def test_dedup_is_exact(spark, group):
    """Groups as they are, and split up to prefixes of whole windows."""
    rows = [*enumerate(corpus(3)), (500, "q " + " ".join(f"k{i}" for i in range(36))), (501, "r " + " ".join(f"k{i}" for i in range(35))), (502, "same " * 3), (502, "same " * 40), (None, "n " * 36)]
    starts = collections.Counter()
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for _, w in words:
        starts.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = collections.Counter()
    for i, w in words:
        gone = {j for k in range(len(w) - 34) if starts[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        want[i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    out = substring_dedup.substring_dedup(docs(spark, rows), group=group)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == want
    assert substring_dedup.substring_dedup(docs(spark, []).limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 16]) for i in range(70)]
    bad = [(80, None), (100, [None, 1.0, 1.0, 1.0]), (101, [float("nan")] * 4), (102, [float("inf")] * 4), (None, [1.0] * 4), (120, [1.0]), (3, rows[3][1])]
    df = topk_search.usable(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5))
    got = [tuple(r) for r in topk_search.exact_topk(df.where("vec_id % 20 = 0"), df, 5, tile_bytes=64).orderBy("query_id", "rank").collect()]
    ints = [(i, np.floor(64 * np.float32(v).astype(float))) for i, v in [*rows, (3, rows[3][1])]]
    want = []
    for q, x in ints:
        if q % 20 == 0:
            best = sorted(((int(x @ y), i) for i, y in ints if i != q), key=lambda s: (-s[0], s[1]))[:5]
            want += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    assert got == want
    # sums over 2**53 stay exact
    huge = topk_search.usable(spark.createDataFrame([(0, [2.0**21, 1.0]), (1, [2.0**21, 1.0]), (2, [2.0**21, 1.015625])], "vec_id long, embedding array<double>"))
    found = topk_search.exact_topk(huge.where("vec_id = 0"), huge, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 2**54 + 64 * 65), (1, 2**54 + 64 * 64)]


@pytest.mark.parametrize("kind", [np.int64, object])
def test_top_k_with_repeated_own_rows(kind):
    """Rows of the query's own id that score best take no place of others, however many there are."""
    rng = np.random.default_rng(3)
    ids = np.sort(np.concatenate([rng.permutation(200)[:100], [40] * 5, [80] * 30]))
    own = np.array([40, 80, 999])
    scores = rng.integers(-9, 10, (3, len(ids)))
    scores[own[:, None] == ids] = 50
    r, i, s = topk_search.best(scores.astype(kind), ids, own, 20)
    for q in range(3):
        want = sorted(((int(x), int(v)) for x, v in zip(scores[q], ids) if v != own[q]), key=lambda x: (-x[0], x[1]))[:20]
        assert list(zip(s[r == q].tolist(), i[r == q].tolist())) == want
    r, _, _ = topk_search.best(np.ones((1, 3), kind), np.array([7, 7, 7]), np.array([7]), 20)
    assert len(r) == 0


def test_mixing_deviates_by_less_than_a_block():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        weights, blocks = rng.random(7) + 0.01, rng.integers(1, 400, 7)
        plan = source_mixing.phases(blocks, weights, 100)
        source = np.repeat(np.arange(7), blocks)
        slot, phase = source_mixing.slot_of(plan, source, np.concatenate([np.arange(b) for b in blocks]))
        assert sorted(slot) == list(range(blocks.sum()))  # every block once, no idle slot
        order = source[np.argsort(slot)]
        for p in plan:
            share = p["q"] / p["q"].sum()
            part = order[p["start"] : p["start"] + p["length"]]
            for i, s in enumerate(p["active"]):
                assert np.abs(np.cumsum(part == s) - share[i] * np.arange(1, len(part) + 1)).max() < 1


def test_mixing_positions(spark):
    rows = [(i, "x" * (i % 7)) for i in range(50)] + [(None, "abc"), (7, "other"), (8, None)]
    df = docs(spark, rows)
    many = source_mixing.mix_sources(df, block_chars=10, range_rows=5)
    one = source_mixing.mix_sources(df, block_chars=10, range_rows=1000)
    key = lambda d: sorted((r.doc_id or -1, r.tie or 0, r.source, r.block, r.slot, r.phase) for r in d.collect())
    assert key(many) == key(one) and many.count() == 53
    assert source_mixing.mix_sources(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = ["é" * 60, None, "short", "short", "é" * 60, "", "y" * 100, "y" * 99, "é" * 60]
    rows = [(i + 1, f"http://www.a.org/p{i % 2}#x" if i else None, h) for i, h in enumerate(html)] + [(None, "http://a.org", "é" * 60), (9, "http://b.org/[", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    archives = warc_archive.write_archives(pages)
    got = warc_archive.capture_histories(archives, 3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.payload_bytes in {len((h or "").encode()) for _, _, h in rows}
        if r.payload_digest == hashlib.sha256(("é" * 60).encode()).hexdigest():
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 1 else ("revisit", 1))
        else:
            assert (r.record_type, r.refers_to) == ("response", None)
    keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in sorted(got, key=lambda r: (r.range, r.place))]
    assert keys == sorted(keys)
    warc_archive.export_archives(archives, str(tmp_path))
    assert sum(len(warc_archive.parse((tmp_path / f).read_bytes())) for f in os.listdir(tmp_path)) == len(rows)
    assert warc_archive.capture_histories(warc_archive.write_archives(pages.limit(0))).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(4)
    for k in range(6):
        runs = [sorted(rng.integers(0, 9, int(rng.integers(0, 8))).tolist()) for _ in range(k)]
        assert list(warc_archive.LoserTree(runs)) == sorted(x for r in runs for x in r)


def held_out(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def test_language_id(spark):
    rng = np.random.default_rng(6)
    letters = {"aa": "abcdef ", "bb": "uvwxyzé "}
    rows = [(i, "".join(rng.choice(list(letters["aa" if i % 2 else "bb"]), 60)), "aa" if i % 2 else "bb") for i in range(200)] + [(900, None, "aa"), (901, "12 !", "bb"), (902, "", None), (None, "uvw", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known, table = language_id.train(df)
    got = {r.doc_id: r for r in language_id.predict(df, known, table).collect()}
    assert known == ["aa", "bb"] and all(got[i].lang_pred == got[i].lang for i in range(200))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[None].lang_pred == "bb"
    none, empty = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none, empty).collect()} == {"und"}


def labelled(spark, make):
    rows = [(i, make(i), i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(700, None), (701, ""), (None, "x")], "doc_id long, text string")
    return df, rows, lambda name, good: spark.createDataFrame([(i, int(y == good)) for i, _, y in rows] + [(None, 1), (1, None)], f"doc_id long, {name} int")


def test_quality(spark):
    rng = np.random.default_rng(7)
    df, rows, labels = labelled(spark, lambda i: " ".join(("BAD!!" if i % 3 == 0 and rng.random() < 0.5 else "fine") + str(rng.integers(9)) for _ in range(40)))
    got = {r.doc_id: r for r in quality_rank.quality_scores(df, labels("quality", False)).collect()}
    test = [i for i, _, _ in rows if held_out(i, 5, 0)]
    assert np.mean([got[i].predicted == int(i % 3 != 0) for i in test]) > 0.95 and all(got[i].held_out for i in test)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == 303
    assert {r.score for r in quality_rank.quality_scores(df, labels("quality", False).limit(0)).collect()} == {0.5}


def test_toxicity_finds_sentences(spark):
    rng = np.random.default_rng(8)
    make = lambda i: " ".join("".join(rng.choice(list("abcd"), 4)) + ("." if k % 6 == 5 else "") for k in range(60)) + (" You vile slug. End" if i % 3 == 0 else " You. End")
    df, rows, labels = labelled(spark, make)
    got = {r.doc_id: r for r in toxicity_mil.toxicity_scores(df, labels("toxic", True)).collect()}
    test = [i for i, _, _ in rows if held_out(i, 3, 1)]
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in test]) > 0.95
    text = {i: t for i, t, _ in rows}
    for i in test:
        if i % 3 == 0:
            assert any("vile slug" in text[i][s.start : s.end] for s in got[i].offending)
    assert got[700].score == got[701].score == 0 and len(got) == 303
    assert max(r.score for r in toxicity_mil.toxicity_scores(df, labels("toxic", True).limit(0)).collect()) < 1e-9


def brute_rules(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark):
    xxhash = pytest.importorskip("xxhash")
    rows = [*corpus(9), "a b c d e f g h i a b c d e f g h", "x\ny\n\nx\nx \n \n \nx", "#a $b\x0bc\x0c|<d>\r&e* %", "w " * 60, " ".join(f"t{i}" for i in range(40))]
    df = docs(spark, rows)
    trusted = df.where("doc_id % 2 = 0").select("doc_id")
    table = quality_rules.learn(df, trusted)
    signed = lambda h: h - (h >> 63 << 64)
    word = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42)
    pair = lambda a, b: xxhash.xxh64_intdigest(word(b).to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(word(a).to_bytes(8, "little"), seed=42))
    grams = lambda w: [signed(h) % quality_rules.BUCKETS for h in [*map(word, w), *map(pair, w, w[1:])]]
    raw, good = collections.Counter(), collections.Counter()
    for i, t in enumerate(rows):
        for b in grams(WORD.findall(t or "")):
            raw[b] += 1
            good[b] += i % 2 == 0
    ratio = lambda c, b: np.log((c[b] + 1) / (sum(c.values()) + quality_rules.BUCKETS))
    want = [ratio(good, b) - ratio(raw, b) if raw[b] else 0.0 for b in range(quality_rules.BUCKETS)]
    assert table == pytest.approx(want)
    for r in quality_rules.judge(df, table, 0.0).collect():
        base = brute_rules(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        w = WORD.findall(rows[r.doc_id] or "")
        mean = sum(want[b] for b in grams(w)) / max(2 * len(w) - 1, 1)
        assert r.ratio == pytest.approx(mean, abs=1e-9) and r.kept == (not r.base_failed and r.ratio >= 0)
    assert quality_rules.judge(df.limit(0), table).count() == 0


def model():
    pytest.importorskip("public_tokenizers")
    return piece_lattice.Vocabulary.load(piece_lattice.default_model())


def test_piece_lattice_against_all_segmentations():
    v = model()
    score = {v.pieces[i]: int(v.score[i]) for i in range(len(v.pieces)) if v.score[i] > piece_lattice._LOW}

    def all_of(t):
        s, out = "▁" + t.replace(" ", "▁"), []

        def go(i, lens, total):
            if i == len(s):
                out.append((-total, tuple(-x for x in reversed(lens))))
            for k in range(1, min(v.longest, len(s) - i) + 1):
                p = s[i : i + k]
                if p in score or k == 1:
                    go(i + k, [*lens, k], total + score.get(p, v.unk))

        go(0, [], 0)
        return sorted(out)[:4]

    rng = np.random.default_rng(10)
    parts = ["the", "in", "hello", "x", "é", "日本", "𝄞", "an", "  ", "a b", " ", "\n"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 4))))[:10] for _ in range(80)] + ["", " ", "a▁b"]
    raw = [t.encode() for t in texts]
    got = piece_lattice.encode_slice(v, b"".join(raw), np.cumsum([0, *map(len, raw)]))
    for t, found in zip(texts, got, strict=True):
        assert [-s for s, _ in found] == ([x[0] for x in all_of(t)] if t else [])
        assert len({tuple(i.tolist()) for _, i in found}) == len(found)
        for _, ids in found:
            assert v.decode(ids).decode() == t.replace("▁", " ")


def test_pieces_round_trip(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model()
    rows = [*corpus(11), "long " * 3000, "z" * 5000]
    out = piece_lattice.decode(piece_lattice.encode(docs(spark, rows))).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.default_model())
    for r in out:
        t = rows[r.doc_id]
        assert r.decoded == t and r.decoded_ok == (None if t is None else True)
        assert t is None or sp.decode(list(r.piece_ids)) == t
    assert piece_lattice.encode(docs(spark, []).limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t) for i, t in enumerate(corpus(12))]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in after.select("doc_id").collect()}
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == df.columns
            df = after
    lettered = {i for i, t in rows if t and re.search(r"[^\W\d_]", t)}
    groups = brute_join([(i, t) for i, t in rows if i in lettered])
    assert seen["language_id"] == lettered and seen["ngram_join"] == {g for _, g in groups.values()}
    assert seen["substring_dedup"] == seen["mix_sources"] == seen["sentencepiece"] == seen["ngram_join"]
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen["sentencepiece"])
    json.dumps(sorted(seen["mix_sources"]))


def test_pipeline_keeps_the_mix(spark, tmp_path):
    """The last stage's rows can be put in the order of the mix, though larger files are read first."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sizes = [3, 40, 9, 25]
    ids = iter(np.random.default_rng(4).permutation(sum(sizes)).tolist())
    want = []
    for n, size in enumerate(sizes):
        part = [(next(ids), f"some text {n} " * (1 + n)) for _ in range(size)]
        want += [i for i, _ in part]
        docs(spark, part).drop("score", "n_words").coalesce(1).write.parquet(str(tmp_path / f"{n}"))
        (file,) = (tmp_path / f"{n}").glob("*.parquet")
        (tmp_path / "mixed").mkdir(exist_ok=True)
        file.rename(tmp_path / "mixed" / f"part-0000{n}.parquet")
    out = pipeline.stage_sentencepiece(spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).repartition(3)
    out.write.parquet(str(tmp_path / "pieces"))
    rows = spark.read.parquet(str(tmp_path / "pieces")).orderBy("mix_position").collect()
    assert [r.doc_id for r in rows] == want and [r.mix_position for r in rows] == list(range(len(want)))


def test_pipeline_without_known_languages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = docs(spark, ["a clean text", "12 !", "", None, "é"], lang=lambda i: None)
    assert sorted(r.doc_id for r in pipeline.stage_language_id(spark, rows, "").collect()) == [0, 4]
