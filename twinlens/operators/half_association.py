"""Associations of columns in both halves of many simulations, from one pass over the table.

Each pair of columns has cells (levels of its categories) with counts and sums, a vector
with one entry a simulation for half A and one number for all rows; half B is the rest.
Cells are combined by key, so the work that grows with rows times simulations is done
where the rows are read.  Nothing is broadcast; what reaches the driver is one row for
each pair of categories.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import AnalysisSchema, q
from . import halves
from .association import column_pairs

#: Kinds of cells: pairs of numbers, a level with a number, two levels, and the margins and sizes of two levels.
NUMBERS, LEVEL, LEVELS, FIRST, SECOND, SIZE = range(6)
#: A spread under this share of the squares is rounding.
ROUNDING = 1e-12
CELL = "kind int, pair int, x string, y string, n long, a binary, v binary"


def _cells(table: pa.Table, sims: int, numeric: list, mixed: list, levels: list) -> Iterator[pa.RecordBatch]:
    """Cells of one chunk of rows.  ``numeric``, ``mixed``, ``levels``: names of the columns of each pair."""
    bits = halves.members(halves.column(table, "halves"), sims)
    numbers = {c: halves.column(table, c) for c in {c for p in numeric for c in p} | {c for _, c in mixed}}
    coded = {c: halves.column(table, c).dictionary_encode() for c in {c for p in levels for c in p} | {c for c, _ in mixed}}
    known = {c: x.is_valid().to_numpy(zero_copy_only=False) for c, x in numbers.items()} | {c: x.indices.is_valid().to_numpy(zero_copy_only=False) for c, x in coded.items()}
    value = {c: x.fill_null(0.0).to_numpy(zero_copy_only=False) for c, x in numbers.items()}
    code = {c: x.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c, x in coded.items()}

    def rows(kind: int, pair: int, x: pa.Array | None, y: pa.Array | None, n: np.ndarray, a: np.ndarray, v: np.ndarray | None = None) -> pa.RecordBatch:
        size, none = len(n), pa.nulls(len(n), pa.string())
        doubles = pa.array([b""] * size, pa.binary()) if v is None else halves.binaries(v.reshape(size, -1))
        same = lambda k: pa.array(np.full(size, k, np.int32))
        return pa.RecordBatch.from_arrays([same(kind), same(pair), none if x is None else x, none if y is None else y, pa.array(n.astype(np.int64)), halves.counted(a), doubles], names=["kind", "pair", "x", "y", "n", "a", "v"])

    def sums(parts: list[np.ndarray], some: np.ndarray, at: np.ndarray) -> np.ndarray:
        """cells x parts x (simulations, all rows): sums of each part over the rows ``some``, cells beginning at ``at``."""
        out = np.empty((len(at), len(parts), sims + 1))
        for k, p in enumerate(parts):
            out[:, k, :sims] = np.add.reduceat(bits[some] * p[some, None], at, axis=0)
            out[:, k, sims] = np.add.reduceat(p[some], at)
        return out

    for k, (c, d) in enumerate(numeric):
        some = np.flatnonzero(known[c] & known[d])
        if len(some):
            x, y = value[c], value[d]
            zero = np.zeros(1, np.int64)
            yield rows(NUMBERS, k, None, None, np.array([len(some)]), bits[some].sum(0, dtype=np.int64)[None], sums([x, y, x * x, y * y, x * y], some, zero))
    for k, (c, d) in enumerate(mixed):
        some = np.flatnonzero(known[c] & known[d])
        if len(some):
            some = some[np.argsort(code[c][some], kind="stable")]
            at = halves.starts(code[c][some])
            x = coded[c].dictionary.take(pa.array(code[c][some][at]))
            yield rows(LEVEL, k, x, None, np.diff(at, append=len(some)), np.add.reduceat(bits[some], at, axis=0, dtype=np.int64), sums([value[d], value[d] * value[d]], some, at))
    for k, (c, d) in enumerate(levels):
        some = np.flatnonzero(known[c] & known[d])
        if not len(some):
            continue
        some = some[np.lexsort((code[d][some], code[c][some]))]
        at = halves.starts(code[c][some], code[d][some])
        x, y = code[c][some][at], code[d][some][at]
        n, a = np.diff(at, append=len(some)), np.add.reduceat(bits[some], at, axis=0, dtype=np.int64)
        yield rows(LEVELS, k, coded[c].dictionary.take(pa.array(x)), coded[d].dictionary.take(pa.array(y)), n, a)
        at = halves.starts(x)
        yield rows(FIRST, k, coded[c].dictionary.take(pa.array(x[at])), None, np.add.reduceat(n, at), np.add.reduceat(a, at, axis=0))
        by = np.argsort(y, kind="stable")
        at = halves.starts(y[by])
        yield rows(SECOND, k, None, coded[d].dictionary.take(pa.array(y[by][at])), np.add.reduceat(n[by], at), np.add.reduceat(a[by], at, axis=0))
        yield rows(SIZE, k, None, None, np.array([n.sum()]), a.sum(0)[None])


def _sides(n: np.ndarray, a: np.ndarray) -> np.ndarray:
    """cells x sides x simulations."""
    return np.stack([a, n[:, None] - a], 1).astype(float)


def _sums_of_sides(v: pa.Array, parts: int, sims: int) -> np.ndarray:
    """cells x parts x sides x simulations."""
    s = halves.matrix(v, "<f8").reshape(len(v), parts, sims + 1)
    return np.stack([s[:, :, :sims], s[:, :, sims:] - s[:, :, :sims]], 2)


def _statistics(table: pa.Table, sims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """kind, pair, statistics x sides x simulations, of the cells of one chunk but those of two levels."""
    kinds, pairs = table.column("kind").to_numpy(), table.column("pair").to_numpy()
    for kind, pair in sorted(set(zip(kinds.tolist(), pairs.tolist()))):
        part = table.take(pa.array(np.flatnonzero((kinds == kind) & (pairs == pair))))
        n = _sides(part.column("n").to_numpy(), halves.counts(halves.column(part, "a"), sims))
        if kind == NUMBERS:
            yield kind, pair, np.concatenate([n[:, None], _sums_of_sides(halves.column(part, "v"), 5, sims)], 1).sum(0)
        elif kind == LEVEL:
            s = _sums_of_sides(halves.column(part, "v"), 2, sims)
            y, yy = s[:, 0], s[:, 1]
            square = np.where(n > 0, y * y / np.maximum(n, 1), 0.0)
            yield kind, pair, np.stack([n, y, square, np.where(n > 0, yy - square, 0.0), np.where(n > 0, yy, 0.0)], 1).sum(0)
        elif kind in (FIRST, SECOND):
            yield kind, pair, np.stack([(n > 0).sum(0), np.where(n > 0, n, np.inf).min(0), n.max(0)])


def _merged(kind: int, parts: list[np.ndarray]) -> np.ndarray:
    s = np.stack(parts)
    if kind in (FIRST, SECOND):
        return np.stack([s[:, 0].sum(0), s[:, 1].min(0), s[:, 2].max(0)])
    return np.stack([s[:, 0].sum(0), s[:, 1].max(0)]) if kind == LEVELS else s.sum(0)


def _value(method: int, s: dict[int, np.ndarray], size: np.ndarray | None) -> np.ndarray:
    """sides x simulations; NaN is a value, -inf stands for none."""
    none = -np.inf
    with np.errstate(all="ignore"):
        if method == NUMBERS:
            n, x, y, xx, yy, xy = s[NUMBERS]
            vx, vy, cov = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2, xy / n - x / n * (y / n)
            constant = (n == 0) | (vx <= ROUNDING * xx / n) | (vy <= ROUNDING * yy / n)
            return np.where(constant, none, cov / np.sqrt(vx * vy))
        if method == LEVEL:
            n, y, square, within, yy = s[LEVEL]
            between, within = np.maximum(square - y * y / n, 0.0), np.maximum(within, 0.0)
            return np.where((n == 0) | (between + within <= ROUNDING * yy), none, between / (between + within))
        chi, gap = s[LEVELS]
        rows, r1, r2 = s[FIRST]
        cols, c1, c2 = s[SECOND]
        least = np.minimum(rows, cols) - 1
        shrunk = gap - np.minimum(0.5, gap)
        yates = shrunk * shrunk * (size * size * (1 / (r1 * r2)) * (1 / (c1 * c2)) * size)
        statistic = np.where((rows == 2) & (cols == 2), yates, np.maximum(chi * size - size, 0.0))
        return np.where(least > 0, np.sqrt(statistic / size / least), none)


def half_associations(original: DataFrame, schema: AnalysisSchema, n: int | None, seeds: Sequence[int]) -> DataFrame:
    """sim, column_1, column_2, original (half A), synthetic (half B); ``n`` and ``seeds`` as for ``with_halves``."""
    sims, named = len(seeds), {c: f"c{k}" for k, c in enumerate(schema.columns)}
    nn, cn, cc = column_pairs(schema)
    pairs = [*nn, *cn, *cc]
    short = [[(named[c], named[d]) for c, d in kind] for kind in (nn, cn, cc)]
    # Sums are taken about the means, so that little is lost when they are subtracted.
    means = original.agg(F.lit(0), *(F.avg(q(c).cast("double")) for c in schema.numeric)).first()[1:]  # one row
    numbers = [(q(c).cast("double") - F.lit(m if m is not None and np.isfinite(m) else 0.0)).alias(named[c]) for c, m in zip(schema.numeric, means)]
    rows = halves.with_halves(original.select("row_id", *numbers, *(q(c).cast("string").alias(named[c]) for c in schema.categorical)), n, seeds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in halves.chunks(batches):
            yield from _cells(table, sims, *short)

    keys = ["kind", "pair", "x", "y"]
    cells = halves.kept(halves.summed(rows.mapInArrow(cut, CELL), keys, sims, ["v"]))
    sizes = {}
    if cc:
        decoded = [(r["pair"], r["n"], pa.array([bytes(r["a"])], pa.binary())) for r in cells.where(F.col("kind") == SIZE).select("pair", "n", "a").collect()]
        sizes = {pair: _sides(np.array([n]), halves.counts(a, sims))[0] for pair, n, a in decoded}

    def packed(found: dict[tuple[int, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (kind, pair), parts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([pair], pa.int32()), pa.array([kind], pa.int32()), pa.array([_merged(kind, parts).astype("<f8").tobytes()])], names=["pair", "kind", "s"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for table in halves.chunks(batches, 4096):
            for kind, pair, s in _statistics(table, sims):
                found[kind, pair] = [_merged(kind, [*found.get((kind, pair), []), s])]
        yield from packed(found)

    def double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for table in halves.chunks(batches, 4096):
            of = table.column("pair").to_numpy()
            for pair in np.unique(of).tolist():
                part = table.take(pa.array(np.flatnonzero(of == pair)))
                n, r, c = (_sides(part.column(f"{k}n").to_numpy(), halves.counts(halves.column(part, f"{k}a"), sims)) for k in ("", "x", "y"))
                expected = r * c / np.maximum(sizes[pair], 1)
                chi = np.where(n > 0, n * n / np.maximum(r * c, 1), 0.0).sum(0)
                gap = np.where(n > 0, np.abs(n - expected), 0.0).max(0)
                found[LEVELS, pair] = [_merged(LEVELS, [*found.get((LEVELS, pair), []), np.stack([chi, gap])])]
        yield from packed(found)

    def values(table: pa.Table) -> pa.Table:
        pair = table.column("pair")[0].as_py()
        found: dict[int, list[np.ndarray]] = {}
        for kind, s in zip(table.column("kind").to_pylist(), table.column("s").to_pylist()):
            found.setdefault(kind, []).append(np.frombuffer(s, "<f8").reshape(-1, 2, sims))
        method = min(found)  # the margins of two levels are numbered after them
        v = _value(method, {k: _merged(k, p) for k, p in found.items()}, sizes.get(pair))
        at = pair + [0, len(short[0]), len(short[0]) + len(short[1])][method]
        side = lambda k: pa.array(v[k], mask=np.isneginf(v[k]), from_pandas=False)
        return pa.table([pa.array(np.arange(sims, dtype=np.int32)), pa.array(np.full(sims, at, np.int32)), side(0), side(1)], names=["sim", "at", "original", "synthetic"])

    stats = "pair int, kind int, s binary"
    out = cells.where(F.col("kind").isin(NUMBERS, LEVEL, FIRST, SECOND)).mapInArrow(single, stats)
    if cc:
        margin = lambda kind, level, name: cells.where(F.col("kind") == kind).select("pair", level, F.col("n").alias(f"{name}n"), F.col("a").alias(f"{name}a"))
        inner = cells.where(F.col("kind") == LEVELS).select("pair", "x", "y", "n", "a")
        # Counts compress so well that a broadcast would be chosen for what no driver holds.
        joined = inner.join(margin(FIRST, "x", "x").hint("merge"), ["pair", "x"]).join(margin(SECOND, "y", "y").hint("merge"), ["pair", "y"])
        out = out.unionByName(joined.mapInArrow(double, stats))
    kind = F.when(F.col("kind").isin(FIRST, SECOND), LEVELS).otherwise(F.col("kind"))
    found = out.withColumn("method", kind).groupBy("method", "pair").applyInArrow(values, "sim int, at int, original double, synthetic double")
    # No row is known in both columns of a pair: no value.
    every = original.sparkSession.range(sims).select(F.col("id").cast("int").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("at"))
    names = F.array(*(F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2")) for a, b in pairs))
    return every.join(found.hint("merge"), ["sim", "at"], "left").select("sim", F.inline(F.array(names[F.col("at")])), "original", "synthetic")
