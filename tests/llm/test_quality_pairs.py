"""op2 learns from all labelled rows and all pairs of them, against brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("episodelens.llm.registry")
from episodelens.llm import _pairs, _text, quality_rank  # noqa: E402


def all_pairs(x, y, ridge):
    """Weights by Newton steps over every pair, written out."""
    spread = x.std(0)
    spread[spread < 1e-9] = 1
    d = ((x[y == 1][:, None] - x[y == 0][None]) / spread).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        w -= 0.7 * np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), -p @ d / len(d) + ridge * w)
    return w / spread


def texts_of(rng, n):
    y = (rng.random(n) < 0.7).astype(int)
    return y, [" ".join(rng.choice(["fine", "plain", "BAD!!", "a;b", "42"], 12, p=[0.4, 0.3, 0.1, 0.1, 0.1] if v else [0.25, 0.25, 0.25, 0.15, 0.1])) + f" {rng.integers(10**9)}" for v in y]


def learned(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def features(texts):
    data, offsets = _text.string_buffers(pa.array(texts))
    return quality_rank.features(_text.Words(data, offsets)).astype(np.float32).astype(float)


@pytest.mark.parametrize("far", [0, 300])
def test_weights_are_those_of_all_pairs(far):
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(300, 4)), np.full((300, 1), 0.1)])
    x[:2, 1] += far  # outliers
    y = (x @ np.array([2.0, -0.3, 0.5, 0.0, 1.0]) + rng.normal(size=300) > 0.7).astype(int)
    w, cut, scale = quality_rank.fit(x, y, ridge=0.01)
    assert w == pytest.approx(all_pairs(x, y, 0.01), abs=1e-6)
    s = x @ w
    assert cut == np.quantile(s, (y == 0).mean()) and scale == 2 / (np.median(s[y == 1]) - np.median(s[y == 0]))


def test_sums_over_pairs_by_nodes():
    """Loss and slopes of strengths near and far against all pairs."""
    rng = np.random.default_rng(2)
    x, y = np.concatenate([rng.normal(size=200) * 3, [-900.0, 700.0]])[:, None], rng.integers(0, 2, 202)
    one = np.ones(1)
    n = float((y == 1).sum() * (y == 0).sum())
    loss, tables = _pairs._over_pairs(_pairs._masses(x, y, 0 * one, one, one), n)
    d = x[y == 1] - x[y == 0].T
    assert loss == pytest.approx(np.logaddexp(0, -d).mean(), rel=1e-10)
    slopes = _pairs._slopes(x, y, 0 * one, one, one, tables)[0, 0]
    assert slopes == pytest.approx([-(np.exp(-np.logaddexp(0, d)) * d).mean()], abs=1e-9)


@pytest.mark.parametrize("at_once", [16, 1])
def test_the_table_is_learned_from_as_rows_in_memory(spark, monkeypatch, at_once):
    monkeypatch.setattr(_pairs, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    y, texts = texts_of(rng, 400)
    df = spark.createDataFrame([(i, t, int(v)) for i, (t, v) in enumerate(zip(texts, y))] + [(9000, None, 0), (None, "x", 1), (9001, "y", None), (9003, "z", 7)], "doc_id long, text string, quality int").repartition(7)
    w, cut, scale = quality_rank.learn(df, df)
    own = [i for i in range(400) if learned(i)]
    x, y = features([texts[i] for i in own]), y[own]
    assert w == pytest.approx(all_pairs(x, y, quality_rank.RIDGE), rel=1e-4, abs=1e-5)
    s = (x * w).sum(1)
    assert cut == pytest.approx(np.quantile(s, (y == 0).mean()), abs=1e-12)
    assert scale == pytest.approx(2 / (np.median(s[y == 1]) - np.median(s[y == 0])), rel=1e-12)


def test_the_cut_counts_all_learned_rows(spark):
    """As many learned rows fall below the cut as are labelled 0; a cut from 6,000 of these rows misses that."""
    rng = np.random.default_rng(4)
    y, texts = texts_of(rng, 20_000)
    df = spark.createDataFrame([(i, t, int(v)) for i, (t, v) in enumerate(zip(texts, y))], "doc_id long, text string, quality int")
    got = {r.doc_id: r.predicted for r in quality_rank.quality_scores(df, df).select("doc_id", "predicted").collect()}
    own = [i for i in range(20_000) if learned(i)]
    assert len(own) > 12_000 and sum(got[i] == 0 for i in own) == int((y[own] == 0).sum())


def test_quantiles_of_equal_and_signed_strengths(spark):
    rng = np.random.default_rng(5)
    s = np.concatenate([np.zeros(300), -np.zeros(5), rng.normal(size=100) * 10.0 ** rng.integers(-9, 9, 100), np.full(50, -1.5)])
    y = rng.integers(0, 2, len(s))
    keyed = spark.createDataFrame(list(zip(y.tolist(), _pairs.order_keys(s).tolist())), "y int, key long")
    wanted = [([0, 1], 0.1, len(s)), ([0, 1], 0.93, len(s)), ([1], 0.5, int(y.sum())), ([0], 0.0, int((y == 0).sum())), ([0], 1.0, int((y == 0).sum()))]
    assert _pairs.quantiles(keyed, wanted) == pytest.approx([np.quantile(s[np.isin(y, c)], q) for c, q, _ in wanted], rel=1e-12)


def test_features_are_of_the_text_alone():
    texts = ["one two 4", "42 is 7", "", "7 b\nb", "b\nb"]
    assert np.array_equal(features(texts), np.concatenate([features([t]) for t in texts]))
