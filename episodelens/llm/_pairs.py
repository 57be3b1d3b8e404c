"""Bradley-Terry weights from all pairs of two classes, in time linear in the rows.

The loss is the mean over all pairs (g, b) of log(1 + exp(s_b - s_g)), s = w.z.
Sums over pairs of a smooth function of s_g - s_b need no pairs: each strength is
spread over nodes of a grid with Lagrange weights, so that the sum over pairs of
rows becomes one over pairs of nodes (``STEP``: to about 1e-12 for each pair).
A Newton round takes two passes over the rows, one for the masses of the nodes,
one for the gradient and the Hessian; between rounds only sums of a fixed size
travel, of up to ``tasks`` tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import string_buffers

#: Grids as (step, nodes of a strength): of loss and gradient; of the Hessian, whose linear weights keep it positive.
FINE, COARSE = (1 / 16, 8), (1 / 2, 2)
#: Newton rounds end at a step below TOLERANCE, where the loss no longer falls, or after ROUNDS (about ten are usual).
TOLERANCE, ROUNDS = 1e-6, 100
#: Partial sums of more tasks than this are added up in executors first.
AT_ONCE = 16

Sums = dict[tuple[int, int], np.ndarray]


def strengths(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, with each row's sum independent of the rows beside it."""
    return (x * w).sum(1)


def nodes(s: np.ndarray, grid: tuple[float, int]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes around each strength and their weights: f(s) is about the sum of weights * f(nodes * step)."""
    step, width = grid
    at = s / step
    low = np.floor(at).astype(np.int64) - (width // 2 - 1)
    k = np.arange(width)
    t = (at - low)[:, None]
    weights = np.ones((len(s), width))
    for j in range(width):
        weights[:, k != j] *= (t - j) / (k[k != j] - j)
    return low[:, None] + k, weights


def _counts(x: np.ndarray, y: np.ndarray) -> Sums:
    return {(c, 0): np.concatenate([[(y == c).sum()], x[y == c].sum(0)]) for c in (0, 1)}


def _squares(x: np.ndarray, y: np.ndarray, mean: np.ndarray) -> Sums:
    return {(0, 0): ((x - mean) ** 2).sum(0)}


def _masses(x: np.ndarray, y: np.ndarray, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> Sums:
    """(2 * grid + class, node): mass."""
    s, out = strengths((x - mean) / spread, w), {}
    for k, grid in enumerate((FINE, COARSE)):
        for c in (0, 1):
            at, weights = nodes(s[y == c], grid)
            ids, which = np.unique(at.ravel(), return_inverse=True)
            out |= {(2 * k + c, int(i)): m for i, m in zip(ids, np.bincount(which, weights.ravel(), len(ids))[:, None], strict=True)}
    return out


def _slopes(x: np.ndarray, y: np.ndarray, mean: np.ndarray, spread: np.ndarray, w: np.ndarray, tables: list) -> Sums:
    """(0, 0): gradient; (1, 0): weighted squares of rows; (2 + class, node): sum of rows on the coarse grid."""
    z = (x - mean) / spread
    s = strengths(z, w)
    slope, bend, out = np.zeros(len(s)), np.zeros(len(s)), {}
    for c in (0, 1):
        of = np.flatnonzero(y == c)
        for into, grid, (ids, values) in ((slope, FINE, tables[c]), (bend, COARSE, tables[2 + c])):
            at, weights = nodes(s[of], grid)
            into[of] = (values[np.searchsorted(ids, at)] * weights).sum(1)
        if len(of):
            order = np.argsort(at.ravel(), kind="stable")
            found, starts = np.unique(at.ravel()[order], return_index=True)
            sums = np.add.reduceat(z[of][order // COARSE[1]] * weights.ravel()[order][:, None], starts)
            out |= {(2 + c, int(i)): v for i, v in zip(found, sums, strict=True)}
    return out | {(0, 0): np.where(y == 1, -slope, slope) @ z, (1, 0): ((z * bend[:, None]).T @ z).ravel()}


def _add(into: Sums, more) -> None:
    for key, v in more:
        into[key] = into[key] + v if key in into else v


def _ordered(sums: Sums, kind: int) -> tuple[np.ndarray, np.ndarray]:
    ids = sorted(i for k, i in sums if k == kind)
    return np.array(ids, np.int64), np.array([sums[kind, i] for i in ids])


def _over_pairs(masses: Sums, n: float) -> tuple[float, list]:
    """Mean loss over pairs, and tables of slopes (fine: bad, good) and bends (coarse: bad, good) at the nodes."""
    loss, tables = 0.0, []
    for k, (step, _) in enumerate((FINE, COARSE)):
        (bad, m_bad), (good, m_good) = _ordered(masses, 2 * k), _ordered(masses, 2 * k + 1)
        m_bad, m_good, at_bad, at_good = m_bad[:, 0], m_good[:, 0], np.zeros(len(bad)), np.zeros(len(good))
        for i in range(0, len(good), 256):
            part = slice(i, i + 256)
            d = (good[part, None] - bad) * step
            p = 1 / (1 + np.exp(np.clip(d, -700, 700)))
            if not k:
                loss += float(m_good[part] @ np.logaddexp(0, -d) @ m_bad) / n
            value = p * (1 - p) if k else p
            at_good[part] = value @ m_bad / n
            at_bad += m_good[part] @ value / n
        tables += [(bad, at_bad), (good, at_good)]
    return loss, tables


def _between(sums: Sums, n: float) -> np.ndarray:
    """Sum over pairs of bend * z_g z_b', on the coarse grid."""
    (bad, z_bad), (good, z_good) = _ordered(sums, 2), _ordered(sums, 3)
    out = 0.0
    for i in range(0, len(good), 256):
        p = 1 / (1 + np.exp(np.clip((good[i : i + 256, None] - bad) * COARSE[0], -700, 700)))
        out = out + z_good[i : i + 256].T @ ((p * (1 - p)) @ z_bad)
    return out / n


def weights_of_all_pairs(total: Callable[..., Sums], ridge: float) -> tuple[np.ndarray, int, int] | None:
    """Weights of x that minimise the mean loss plus ridge / 2 of their squares (by x's deviations), rows of class 1 and of class 0; None without both.

    total(kernel, *more) is the sum of kernel(x, y, *more) over all rows.
    """
    first = total(_counts)
    n_good, n_bad = (int(first[c, 0][0]) if first else 0 for c in (1, 0))
    if not n_good or not n_bad:
        return None
    mean = (first[0, 0] + first[1, 0])[1:] / (n_good + n_bad)
    spread = np.sqrt(total(_squares, mean)[0, 0] / (n_good + n_bad))
    spread[spread < 1e-9] = 1
    n = float(n_good) * n_bad

    def at(w: np.ndarray) -> tuple[float, list]:
        loss, tables = _over_pairs(total(_masses, mean, spread, w), n)
        return loss + ridge / 2 * float(w @ w), tables

    w = np.zeros(len(mean))
    loss, tables = at(w)
    for _ in range(ROUNDS):
        sums = total(_slopes, mean, spread, w, tables)
        gradient = sums[0, 0] + ridge * w
        cross = _between(sums, n)
        step = np.linalg.solve(sums[1, 0].reshape(len(w), -1) - cross - cross.T + ridge * np.eye(len(w)), gradient)
        part = 1.0
        while (new := at(w - part * step))[0] > loss - 1e-4 * part * float(gradient @ step) + 1e-10 and part > 1e-6:
            part /= 2
        if part <= 1e-6:
            break
        w, (loss, tables) = w - part * step, new
        if np.abs(part * step).max() < TOLERANCE:
            break
    return w / spread, n_good, n_bad


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows and classes of a batch (y int, x binary of float32)."""
    x = string_buffers(batch.column("x"))[0].view(np.float32)
    return x.reshape(batch.num_rows, -1).astype(float), batch.column("y").to_numpy(zero_copy_only=False)


def totals_over(rows: DataFrame, tasks: int) -> Callable[..., Sums]:
    """total() for weights_of_all_pairs over a table (y int, x binary of float32), in up to tasks tasks."""
    kind = "kind int, node long, v binary"

    def packed(sums: Sums):
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int64()), pa.array([np.asarray(sums[k], float).tobytes() for k in keys], pa.binary())], ["kind", "node", "v"])

    def unpacked(table):
        return (((k, i), np.frombuffer(v)) for k, i, v in zip(*(table.column(c).to_pylist() for c in ("kind", "node", "v")), strict=True))

    def added(batches):
        sums: Sums = {}
        for batch in batches:
            _add(sums, unpacked(batch))
        yield from packed(sums)

    def total(kernel, *more) -> Sums:
        def partial(batches):
            sums: Sums = {}
            for batch in batches:
                if batch.num_rows:
                    _add(sums, kernel(*arrays(batch), *more).items())
            yield from packed(sums)

        found = rows.select("y", "x").coalesce(tasks).mapInArrow(partial, kind)
        if tasks > AT_ONCE:
            found = found.repartition(math.isqrt(tasks)).mapInArrow(added, kind)
        sums: Sums = {}
        _add(sums, unpacked(found.toArrow()))
        return sums

    return total


def _sortable(v: np.ndarray) -> np.ndarray:
    """Longs in the order of doubles; its own inverse but for the type."""
    bits = v.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def order_keys(s: np.ndarray) -> np.ndarray:
    return _sortable(np.ascontiguousarray(s + 0.0))


def quantiles(keyed: DataFrame, wanted: list[tuple[list[int], float, int]]) -> list[float]:
    """Exact quantiles, read between neighbours as numpy does, of a table (y int, key long of order_keys).

    wanted: classes, share, and how many rows these classes have.  Ranks are
    found by counts of the keys' leading 16 bits, then the next: four jobs,
    whatever the rows and however many are equal.
    """
    targets = {}
    for classes, share, n in wanted:
        low = int(share * (n - 1))
        for rank in {low, min(low + 1, n - 1)}:
            targets[tuple(classes), rank] = (0, rank)
    for shift in (48, 32, 16, 0):
        bins = keyed.select("y", F.shiftright("key", shift).alias("bin"), (F.shiftright("key", shift + 16) if shift < 48 else F.lit(0).cast("long")).alias("prefix"))
        got = bins.where(F.col("prefix").isin(sorted({p for p, _ in targets.values()}))).groupBy("prefix", "bin").agg(*(F.count(F.when(F.col("y") == c, 1)).alias(f"n{c}") for c in (0, 1))).toPandas().sort_values("bin")
        for key, (prefix, rank) in targets.items():
            own = got[got.prefix == prefix]
            upto = own[[f"n{c}" for c in key[0]]].sum(axis=1).to_numpy().cumsum()
            k = int(np.searchsorted(upto, rank, "right"))
            targets[key] = (int(own.bin.iloc[k]), rank - (int(upto[k - 1]) if k else 0))
    value = lambda classes, rank: float(_sortable(np.array([targets[tuple(classes), rank][0]], np.int64)).view(float)[0])
    out = []
    for classes, share, n in wanted:
        low = int(share * (n - 1))
        a, b = value(classes, low), value(classes, min(low + 1, n - 1))
        out.append(a + (b - a) * (share * (n - 1) - low))
    return out
