"""Edge cases of the operators: damaged texts, clashing columns, ties, repeated rows, empty tables, hot keys, very long texts."""

import collections
import math
import zlib

import numpy as np
import pytest

pytest.importorskip("episodelens.llm.registry")
from pyspark.sql import functions as F  # noqa: E402

from episodelens.llm import _shared, language_id, ngram_join, piece_lattice, quality_rank, quality_rules, source_mixing, substring_dedup, topk_search, toxicity_mil, warc_archive  # noqa: E402

DAMAGE = [b"\x80\x80", b"abc\xff", b"\xe2\x82", b"\xac then", b"\xc3", b"\xf0\x9f\x98"]


def damaged(spark):
    """Clean texts with damaged ones between them, in one partition."""
    rows = []
    for i, d in enumerate(DAMAGE):
        rows += [(2 * i, bytearray("größe über straße und weiter, Wörter".encode())), (2 * i + 1, bytearray(d))]
    return spark.createDataFrame(rows, "doc_id long, raw binary").coalesce(1).select("doc_id", F.col("raw").cast("string").alias("text"))


def test_damaged_texts_change_no_others(spark):
    df = damaged(spark)
    clean = df.where("doc_id % 2 = 0")
    rng = np.random.default_rng(1)
    known, table = ["de", "en"], np.log(rng.random(((1 << language_id.BITS) + 1, 2)).astype(np.float32) + 0.1)
    near = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, known, table).collect()}
    alone = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(clean, known, table).collect()}
    assert len(near) == 12 and all(near[i] == alone[i] for i in alone)
    pytest.importorskip("public_tokenizers")
    near = {r.doc_id: r for r in piece_lattice.encode(df).collect()}
    alone = {r.doc_id: r for r in piece_lattice.encode(clean).collect()}
    assert all((near[i].piece_ids, near[i].score, near[i].decoded_ok) == (alone[i].piece_ids, alone[i].score, True) for i in alone)
    assert all(r.decoded_ok for r in near.values())


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    action()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_training_takes_as_many_jobs_whatever_the_partitions(spark):
    rows = [(i, f"word{i % 7} vile slug" if i % 3 == 0 else f"word{i % 7} fine day", "aa" if i % 2 else "bb", int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    for op in (language_id.train, lambda d: toxicity_mil.toxicity_scores(d, d)):
        few, many = (jobs_of(spark, f"{n}-{id(op)}", lambda n=n, op=op: op(df.repartition(n, "doc_id"))) for n in (2, 40))
        assert many <= few + 2


def test_language_id_by_brute_force(spark):
    rng = np.random.default_rng(2)
    make = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(1, 40))))
    rows = [(i, make("abcé ") if i % 2 else make("bcdü "), "aa" if i % 2 else "bb") for i in range(80)]
    rows += [rows[3], rows[3], (900, "x" * 200_000, "bb"), (901, "", "aa"), (902, None, "bb")]
    kept = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5 and t is not None]

    def slots(text):
        out = collections.Counter()
        for n in (1, 2, 3):
            for k in range(len(text) - n + 1):
                h = 0
                for size, c in enumerate(text[k : k + n], 1):
                    h = (h * 0x01000193 + ord(c) + size) % 2**32
                out[((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32 >> (32 - language_id.BITS)] += 1
        return out

    counts, docs = {"aa": collections.Counter(), "bb": collections.Counter()}, collections.Counter(x for _, x in kept)
    for t, x in kept:
        counts[x] += slots(t)
    log = lambda x, s: math.log(counts[x][s] + 1) - math.log(sum(counts[x].values()) + (1 << language_id.BITS))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for r in language_id.predict(df, *language_id.train(df)).where("doc_id < 80").collect():
        own = slots(r.text)
        z = [math.log(docs[x] / sum(docs.values())) + sum(n * log(x, s) for s, n in own.items()) for x in ("aa", "bb")]
        if any(c.isalpha() for c in r.text):
            gap = (max(z) - min(z)) / math.sqrt(max(1, sum(own.values())))
            assert r.score == pytest.approx(1 / (1 + math.exp(-gap)), abs=2e-3) and (gap < 1e-3 or r.lang_pred == ("aa", "bb")[z.index(max(z))])
    # ties go to the first language by name
    same = spark.createDataFrame([(i, "same text", x) for i in range(40) for x in ("bb", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.predict(same, *language_id.train(same)).collect()} == {"aa"}


def test_clashing_columns(spark):
    names = ["_letters", "_id", "_key", "_hash", "_blocks", "_rk", "_starts", "_bits", "_c0", "n_words", "score", "piece_ids", "_row", "a.b"]
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40 + i)), *["z"] * len(names)) for i in range(3)], ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    out = substring_dedup.substring_dedup(df)
    assert {r.n_removed for r in out.collect()} == {40, 41} and {"_id", "_blocks", "a.b"} <= set(out.columns) and out.columns.count("n_words") == 1
    known, table = ["aa"], np.zeros(((1 << language_id.BITS) + 1, 1), np.float32)
    out = language_id.predict(df, known, table)
    assert {r["_letters"] for r in out.collect()} == {"z"} and {r.lang_pred for r in out.collect()} == {"aa"}
    assert quality_rules.judge(df, [0.0] * quality_rules.BUCKETS).count() == 3
    assert topk_search.usable(spark.createDataFrame([(1, [1.0], "x")], "vec_id long, embedding array<float>, x string")).first().x == [64.0]
    pages = spark.createDataFrame([(1, "u", "h", "x")], "page_id long, url string, html string, first string")
    assert warc_archive.capture_histories(warc_archive.write_archives(pages)).count() == 1
    pytest.importorskip("public_tokenizers")
    assert piece_lattice.encode(df).first()["_id"] == "z"


def test_classifiers_at_the_edges(spark):
    rows = [(i, ("good words here " if i % 2 else "BAD!! ## ") * 9, i % 2) for i in range(60)] + [(901, "x" * 300_000, 1), (902, "", 0), (903, None, 1)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, quality int").withColumns({"toxic": 1 - F.col("quality"), "y": F.lit("clash"), "score": F.lit("clash")})
    for out in (quality_rank.quality_scores(df, df), toxicity_mil.toxicity_scores(df, df)):
        got = out.collect()
        assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert quality_rank.quality_scores(df.limit(0), df).count() == toxicity_mil.toxicity_scores(df.limit(0), df).count() == 0


def test_noisy_or_and_its_gradient():
    """The document's score is the noisy-or of its sentences, and training lowers the loss that brute force computes."""
    rng = np.random.default_rng(5)
    z, doc = rng.normal(size=12), np.repeat([0, 1, 2], 4)
    want = [1 - np.prod([1 - 1 / (1 + math.exp(-x)) for x in z[doc == d]]) for d in range(3)]
    assert toxicity_mil.bag_scores(z, doc, 4) == pytest.approx([*want, 0.0])
    n = 60
    y = np.arange(n) % 2
    words = [np.array([0, 1] if v else [1, 2], np.int32) for v in y]
    v, b = toxicity_mil.fit(y, np.full(n, 2), words, [np.array([0, 1], np.int32)] * n, 3)
    assert v[0] > 1 and v[0] > v[1] and toxicity_mil.bag_scores(np.array([v[0] + b, v[1] + b]), np.array([0, 0]), 1)[0] > 0.9


def test_bradley_terry_by_gradient_descent():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 4))
    y = (x @ np.array([2.0, -1.0, 0.5, 0.0]) + rng.normal(size=80) > 0).astype(int)
    w, cut, _ = quality_rank.fit(x, y, pairs=2000, ridge=0.1)
    spread, pick = x.std(0), np.random.default_rng(7)
    d = (x[pick.choice(np.flatnonzero(y == 1), 2000)] - x[pick.choice(np.flatnonzero(y == 0), 2000)]) / spread
    slow = np.zeros(4)
    for _ in range(4000):
        slow -= 0.5 * (d.T @ (1 / (1 + np.exp(-(d @ slow))) - 1) / 2000 + 0.1 * slow)
    assert w == pytest.approx(slow / spread, abs=1e-4) and cut == pytest.approx(np.quantile(x @ w, (y == 0).mean()))


def brute_schedule(blocks, weights, period):
    """Slot by slot: of the blocks released so far in this phase, the one due first."""
    done, out = [0] * len(blocks), {}
    slot = 0
    while any(d < b for d, b in zip(done, blocks)):
        active = [s for s in range(len(blocks)) if done[s] < blocks[s]]
        q = source_mixing.integer_weights(np.array([weights[s] for s in active]), period)
        total, base, t = int(q.sum()), list(done), 0
        while all(done[s] < blocks[s] for s in active):
            ready = []
            for i, s in enumerate(active):
                k = done[s] - base[s]
                if k * total // int(q[i]) <= t:
                    ready.append((-(-(k + 1) * total // int(q[i])), i, s))
            _, _, s = min(ready)
            out[s, done[s]] = slot
            done[s] += 1
            slot, t = slot + 1, t + 1
    return out


def test_mixing_by_brute_force():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        blocks, weights = rng.integers(1, 60, 5), rng.random(5) + 0.05
        want = brute_schedule(blocks.tolist(), weights.tolist(), 20)
        source = np.repeat(np.arange(5), blocks)
        block = np.concatenate([np.arange(b) for b in blocks])
        slot, _ = source_mixing.slot_of(source_mixing.phases(blocks, weights, 20), source, block)
        assert {(s, b): t for s, b, t in zip(source.tolist(), block.tolist(), slot.tolist(), strict=True)} == want


def test_mixing_positions_over_many_ranges(spark):
    """Outlying and null doc_ids, a null source, equal rows: positions are sums of the rows before, in many ranges."""
    rng = np.random.default_rng(9)
    rows = [(int(i), f"t{i}", "s", int(rng.integers(9))) for i in range(300)] + [(2**60, "far", "s", 5), (-(2**60), "low", "s", 4), (7, "t7", "s", 3), (7, "t7", "s", 3)]
    rows += [(None, f"n{i}", "s", 2) for i in range(200)] + [(i, "x", None, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(5)
    got = source_mixing.source_positions(df, _shared.Tables(spark, "t"), range_rows=8).collect()
    assert len(got) == len(rows)
    for name in ("s", None):
        own = sorted((r for r in got if r.source == name), key=lambda r: r.before)
        total = 0
        for i, r in enumerate(own):
            assert r.before <= total + 1e-9
            total += r.chars
        ordered = sorted(own, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie, r.chars, r.before))
        assert [r.before for r in ordered] == [sum(x.chars for x in ordered[:i]) for i in range(len(ordered))]
    plan = source_mixing.mix_sources(df, {"s": 3.0, None: 1.0}, block_chars=20, range_rows=8)
    assert plan.count() == len(rows) and plan.select("source", "block", "slot").distinct().groupBy("slot").count().where("count > 1").count() == 0


def test_hot_join_keeps_all_rows(spark):
    rows = spark.createDataFrame([(0, i) for i in range(3000)] + [(1 + i % 50, i) for i in range(500)], "k int, v int")
    found = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3")
    got = _shared.hot_join(rows, found, ["k"], "n", 3500)
    assert got.count() == 3490 and got.where("k = 0 and n = 3000").count() == 3000


def test_top_k_of_nothing(spark):
    df = topk_search.usable(spark.createDataFrame([], "vec_id long, embedding array<float>, rank string"))
    assert topk_search.exact_topk(df, df).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 997}x{i % 991}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short text of a few words"), (4, "y" * 500_000)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(spark, df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df).collect()} == {1: 60_000, 2: 60_000, 3: 0, 4: 0}
    assert {r.doc_id: r.n_words for r in quality_rules.judge(df, [0.0] * quality_rules.BUCKETS).collect()} == {1: 60_000, 2: 60_001, 3: 6, 4: 1}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, other: other)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _shared.shared_dir(Session())
