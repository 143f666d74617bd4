"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document (lengths, character classes, repetition, lines) are
standardised and mapped to ``n_features`` random cosines, whose inner products
approximate a Gaussian kernel.  Every partition adds up the upper triangle of its
normal equations; the sums have a fixed size, and only they reach the driver, which
solves for the ridge weights.  Raw scores are then calibrated by isotonic regression
over fixed bins of the score, summed by partition as well.

*Labels* are a bounded sample, at most ``max_labelled`` rows of lowest hash; one in
four of them is kept from the fit and calibrates.  Their statistics are written once; all
steps of the fit read those.

Defined results: a null or empty text has all statistics 0 and gets a score like
any other; without labelled rows every score is 0; with one class only, scores are
that class; rows that share a doc_id are scored each; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, map_arrow
from ._text import Words, chunks
from .toxicity import Labels

STATISTICS = 18
BLOCKS, BINS = 64, 200
SCORED = "doc_id long, score double"

_CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 space, 5 other ASCII, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 6


def _share_repeated(values: np.ndarray) -> float:
    return 1 - len(np.unique(values)) / len(values) if len(values) else 0.0


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS numbers for each text, over its whole length."""
    out = np.zeros((len(texts), STATISTICS))
    for data, offsets, rows in chunks(texts):
        found = Words(data, offsets, rows, False)
        for k, row in enumerate(rows):
            text = data[offsets[k] : offsets[k + 1]]
            if not len(text):
                continue
            a, b = found.bounds[k], found.bounds[k + 1]
            share = np.bincount(_CLASS[text], minlength=7) / len(text)
            h, length = found.hash[a:b], found.end[a:b] - found.start[a:b]
            n = len(h)
            newline = np.flatnonzero(text == 10)
            line_lengths = np.diff(np.concatenate([[-1], newline, [len(text)]])) - 1
            out[row, :7] = share
            if n:
                pairs = h[:-1] * np.uint64(3) + h[1:] if n > 1 else h
                eights = h[:-7] + sum(h[j : n - 7 + j] * np.uint64(2 * j + 1) for j in range(1, 8)) if n > 8 else h[:0]
                first = text[np.minimum(found.start[a:b] - offsets[k], len(text) - 1)]
                last = text[found.end[a:b] - 1 - offsets[k]]
                out[row, 7:] = (
                    np.log1p(n), length.mean(), length.std(), _share_repeated(h), _share_repeated(pairs), _share_repeated(eights),
                    (_CLASS[first] == 1).mean(), (_CLASS[last] == 3).mean(), np.isin(last, (33, 46, 63)).mean(), np.log1p(line_lengths.mean()), (length == 1).mean(),
                )
    return out


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        cosines = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def labelled_statistics(docs: DataFrame, sample: Labels) -> DataFrame:
    """x (STATISTICS numbers), y, calibration of each row of the sample: texts are read once for all steps of the fit."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value
        for batch in batches:
            place = labels.find(batch.column(0))
            x = statistics(batch.column(1)).astype("<f8")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(labels.toxic[place]), pa.array(labels.calibration[place])], ["x", "y", "calibration"])

    # At most max_labelled ids.
    ids = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"__id": sample.ids})))
    mine = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
    return map_arrow(mine, run, "x binary, y boolean, calibration boolean")


def _summed(table: DataFrame, width: int, rows_of) -> np.ndarray:
    """Sum over the rows of ``table`` of ``rows_of(x, y, calibration)``, an array of ``width`` numbers.

    Partition sums are dealt into blocks, each added up by one task.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width), False
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = np.frombuffer(b"".join(some.column(0).to_pylist()), "<f8").reshape(-1, STATISTICS)
                y, calibration = (some.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (1, 2))
                total += rows_of(x, y.astype(float), calibration)
                seen = True
        if seen:
            for block in range(BLOCKS):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": pa.array([total[block::BLOCKS].astype("<f8").tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["sums"], "<f8")
                sums[row["block"]] = sums.get(row["block"], 0) + values
        for block, total in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = map_arrow(table, part, "block int, sums binary")
    out = np.zeros(width)
    for row in map_arrow(parts.repartition("block"), add, "block int, sums binary").collect():
        out[row.block :: BLOCKS] += np.frombuffer(row.sums, "<f8")
    return out


def isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing shares fitted to good[i] of n[i] in ordered bins (pool adjacent violators)."""
    pools: list[list[float]] = []
    for k in range(len(n)):
        pools.append([good[k], n[k], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g, m, w = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + m, pools[-1][2] + w]
    return np.concatenate([np.full(int(w), g / m if m else 0.0) for g, m, w in pools])


def fit(docs: DataFrame, labelled: DataFrame, n_features: int = 160, gamma: float = 0.06, ridge: float = 1e-3, max_labelled: int = 100_000, seed: int = 7) -> Model | None:
    """docs: doc_id, text; labelled: doc_id, quality of the rows that may be learnt from."""
    sample = Labels.sample(labelled, "quality", max_labelled)
    if not len(sample.ids):
        return None
    store = Scratch(docs.sparkSession, "quality-classifier")
    table = store.put(labelled_statistics(docs, sample), "statistics")
    model = _fitted(table, n_features, gamma, ridge, seed)
    store.drop(table)
    return model


def _fitted(table: DataFrame, n_features: int, gamma: float, ridge: float, seed: int) -> Model | None:
    s = STATISTICS
    moments = _summed(table, 2 * s + 1, lambda x, y, c: np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]]))
    if not moments[-1]:
        return None
    mean = moments[:s] / moments[-1]
    scale = np.sqrt(np.maximum(moments[s : 2 * s] / moments[-1] - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (s, n_features)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.zeros(1), np.zeros(1))
    d = n_features + 1
    upper = np.triu_indices(d)

    def normal(x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> np.ndarray:
        z = model.features(x[~calibration])
        return np.concatenate([(z.T @ z)[upper], z.T @ y[~calibration], [len(z)]])

    sums = _summed(table, len(upper[0]) + d + 1, normal)
    gram = np.zeros((d, d))
    gram[upper] = sums[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    model.weights = np.linalg.solve(gram + ridge * max(sums[-1], 1) / n_features * np.eye(d), sums[len(upper[0]) : -1])
    low, high = -0.5, 1.5

    def bins(x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x[calibration]) - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, y[calibration], BINS), np.bincount(at, minlength=BINS)])

    found = _summed(table, 2 * BINS, bins)
    good, n = found[:BINS], found[BINS:]
    full = np.flatnonzero(n)
    if not len(full):
        return None
    model.edges = low + (full + 0.5) * (high - low) / BINS
    model.levels = isotonic(good[full], n[full])
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier of good quality) for each row; only the text is read."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(statistics(part.column(1))))], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, SCORED)
