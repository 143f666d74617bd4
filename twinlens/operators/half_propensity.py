"""Logistic propensity models of both halves, for many simulations in the same passes.

The model is that of ``propensity_scores``: dummies of all levels, an intercept without
penalty, and C.  A Newton step needs sums over rows only, of which those between levels are
counts by pair of levels; every pass takes them for all simulations that have not converged,
and each simulation's system is solved by a task of its own.  The driver holds the weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import AnalysisSchema, q
from . import halves

#: Doubles that a task sums; simulations beyond go in further passes.
SUMS, ROWS = 1 << 22, 4096


class Layout:
    """Columns of the model (intercept, numbers, levels) and the sums of a pass, as one vector a simulation."""

    def __init__(self, n_numbers: int, levels: list[list[str]]):
        self.q, self.levels = n_numbers, levels
        self.sizes = [len(x) for x in levels]
        self.begin = [1 + n_numbers + sum(self.sizes[:k]) for k in range(len(levels))]
        self.p = 1 + n_numbers + sum(self.sizes)
        self.products = [(i, j) for i in range(n_numbers + 1) for j in range(i, n_numbers + 1)]
        self.pairs = list(combinations(range(len(levels)), 2))
        # loss, sum and squares of p - c; gradient; numbers; numbers by level; levels by level.
        self.shapes = [(3,), (self.p,), (len(self.products),), *((s, n_numbers + 1) for s in self.sizes), *((self.sizes[a], self.sizes[b]) for a, b in self.pairs)]

    @property
    def width(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes)

    def split(self, vector: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
        return [x.reshape(s) for x, s in zip(np.split(vector, ends), self.shapes)]

    def hessian(self, parts: list[np.ndarray]) -> np.ndarray:
        h, k = np.zeros((self.p, self.p)), self.q + 1
        for (i, j), v in zip(self.products, parts[2]):
            h[i, j] = h[j, i] = v
        for at, size, m in zip(self.begin, self.sizes, parts[3:]):
            h[at : at + size, :k], h[:k, at : at + size] = m, m.T
            h[range(at, at + size), range(at, at + size)] = m[:, 0]
        for (a, b), m in zip(self.pairs, parts[3 + len(self.sizes) :]):
            x, y = slice(self.begin[a], self.begin[a] + self.sizes[a]), slice(self.begin[b], self.begin[b] + self.sizes[b])
            h[x, y], h[y, x] = m, m.T
        return h


def _added(parts: list[np.ndarray], layout: Layout, x: np.ndarray, codes: list[np.ndarray], y: np.ndarray, w: np.ndarray, c: float) -> None:
    """Adds the sums of some rows.  ``x``: 1 and the numbers; ``y``: rows x simulations; ``w``: columns x simulations."""
    eta = x @ w[: layout.q + 1]
    for at, code in zip(layout.begin, codes):
        eta += w[at + code]
    small = np.exp(-np.abs(eta))
    p = np.where(eta >= 0, 1.0, small) / (1.0 + small)
    off, r, d = p - c, p - y, small / (1.0 + small) ** 2
    parts[0][0] += (np.maximum(eta, 0.0) + np.log1p(small) - y * eta).sum(0)
    parts[0][1] += off.sum(0)
    parts[0][2] += (off * off).sum(0)
    parts[1][: layout.q + 1] += x.T @ r
    parts[2] += np.stack([x[:, i] * x[:, j] for i, j in layout.products]) @ d
    for k, (at, code) in enumerate(zip(layout.begin, codes)):
        order = np.argsort(code, kind="stable")
        runs = halves.starts(code[order])
        level, sorted_d = code[order][runs], d[order]
        parts[1][at + level] += np.add.reduceat(r[order], runs, axis=0)
        for j in range(layout.q + 1):
            parts[3 + k][level, j] += np.add.reduceat(sorted_d * x[order, j, None] if j else sorted_d, runs, axis=0)
    for k, (a, b) in enumerate(layout.pairs):
        cell = codes[a] * layout.sizes[b] + codes[b]
        order = np.argsort(cell, kind="stable")
        runs = halves.starts(cell[order])
        sums = parts[3 + len(layout.sizes) + k].reshape(-1, y.shape[1])
        sums[cell[order][runs]] += np.add.reduceat(d[order], runs, axis=0)


def _pass(rows: DataFrame, layout: Layout, sims: int, live: list[int], weights: np.ndarray, penalty: np.ndarray, centres: np.ndarray, scales: np.ndarray, c: float) -> dict[int, tuple]:
    """sim: (objective, decrement, sum and squares of p - c, step) at the weights of each live simulation."""
    n_numbers, names = layout.q, [f"k{k}" for k in range(len(layout.sizes))]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros((*s, len(live))) for s in layout.shapes]
        sets = [pa.array(x, pa.string()) for x in layout.levels]
        for table in halves.chunks(batches, ROWS):
            y = 1.0 - halves.members(halves.column(table, "halves"), sims)[:, live]
            x = np.column_stack([np.ones(table.num_rows), *((table.column(f"x{j}").to_numpy() - centres[j]) / scales[j] for j in range(n_numbers))])
            codes = [pc.index_in(halves.column(table, k), value_set=s).to_numpy(zero_copy_only=False).astype(np.int64) for k, s in zip(names, sets)]
            _added(parts, layout, x, codes, y, weights, c)
        whole = np.concatenate([x.reshape(-1, len(live)) for x in parts]).T
        for k in range(len(live)):  # one at a time: a batch has no more than a system
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), halves.binaries(whole[k : k + 1])], names=["k", "sums"])

    def solved(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        parts = layout.split(np.sum([np.frombuffer(x, "<f8") for x in table.column("sums").to_pylist()], axis=0))
        w = weights[:, k]
        g = parts[1] + penalty * w
        step = np.linalg.solve(layout.hessian(parts) + np.diag(penalty), g)
        numbers = [parts[0][0] + (penalty * w * w).sum() / 2, g @ step, *parts[0][1:]]
        return pa.table([pa.array([k], pa.int32()), pa.array([np.array(numbers).tobytes()]), pa.array([step.tobytes()])], names=["k", "numbers", "step"])

    found = rows.mapInArrow(sums, "k int, sums binary").repartition(halves.tasks(rows), "k").groupBy("k").applyInArrow(solved, "k int, numbers binary, step binary")
    return {live[r["k"]]: (*np.frombuffer(bytes(r["numbers"])), np.frombuffer(bytes(r["step"]))) for r in found.collect()}  # one row a simulation


def half_pmse(original: DataFrame, schema: AnalysisSchema, n: int, seeds: Sequence[int], C: float = 1.0, max_iter: int = 1000, tol: float = 1e-9) -> list[tuple[int, float]] | None:
    """(sim, value) of a converged fit of each simulation; None if one system alone is over ``SUMS`` doubles."""
    sims = len(seeds)
    numbers = [q(c).cast("double") for c in schema.numeric]
    row = original.agg(F.lit(0), *(e for c in numbers for e in (F.count_if(c.isNull() | F.isnan(c)), F.avg(c), F.stddev_pop(c)))).first()[1:]  # one row
    if missing := [c for c, k in zip(schema.numeric, row[::3]) if k]:
        raise ValueError(f"missing numbers, which logistic_regression doesn't take: {missing}")
    centres, scales = np.array(row[1::3], float), np.array([s or 1.0 for s in row[2::3]], float)
    kinds = [F.coalesce(q(c).cast("string"), F.lit("\0missing")) for c in schema.categorical]
    known = [original.select(k.alias("k")).distinct() for k in kinds]
    # More levels than a system can have are not fetched.
    levels = [sorted(r["k"] for r in k.limit(SUMS).collect()) if k.count() <= SUMS // 4 else None for k in known]
    if any(x is None for x in levels):
        return None
    layout = Layout(len(numbers), levels)
    if max(layout.width, layout.p * layout.p) > SUMS:
        return None
    plain = original.select("row_id", *(c.alias(f"x{j}") for j, c in enumerate(numbers)), *(c.alias(f"k{j}") for j, c in enumerate(kinds)))
    rows = halves.kept(halves.with_halves(plain, n, seeds))
    # Numbers are scaled for the solver; the penalty stays that of weights of unscaled ones.
    penalty = np.concatenate([[0.0], 1 / (C * scales**2), np.full(sum(layout.sizes), 1 / C)])
    c, enough = (n - n // 2) / n, n * max(tol * tol, 1e-24)
    values: dict[int, float] = {}
    together = max(1, SUMS // layout.width)
    for at in range(0, sims, together):
        live = list(range(at, min(sims, at + together)))
        trial = {s: np.zeros(layout.p) for s in live}
        best: dict[int, tuple[float, np.ndarray, np.ndarray, float]] = {}  # objective, weights, step, its share
        for turn in range(max_iter + 1):
            found = _pass(rows, layout, sims, live, np.column_stack([trial[s] for s in live]), penalty, centres, scales, c)
            for s, (objective, decrement, one, two, step) in found.items():
                if s in best and not objective <= best[s][0] + 1e-9 * (1 + abs(best[s][0])):
                    at_least, w, last, share = best[s]  # too far
                    best[s] = (at_least, w, last, share / 2)
                    trial[s] = w - share / 2 * last
                    if share > 1e-12 and turn < max_iter:
                        continue
                else:
                    best[s] = (objective, trial[s], step, 1.0)
                    trial[s] = trial[s] - step
                values[s] = float(two + (n * (1 - 2 * c) ** 2 - 2 * (1 - 2 * c) * one + two)) / 2 / n
                if decrement <= enough:
                    live.remove(s)
            if not live:
                break
    return sorted(values.items())
