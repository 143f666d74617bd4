"""Mixed distances between records: scaling from the original, and distance kernels.

Scaled features are columns n0, n1, ... (doubles) and c0, c1, ... (texts, NULL is a
category of its own), so that kernels are written once as SQL expressions and once
over NumPy blocks for the neighbour join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import AnalysisSchema, q

METRICS = ("gower", "cosine")
#: Distances are compared as integers of 1e-12, so that float noise decides no tie.
SCALE = 1e12
INFINITE = (1 << 41) - 1


@dataclass(frozen=True)
class Features:
    """How a schema's columns are scaled; ``of`` applies it to any frame of that schema."""

    schema: AnalysisSchema
    metric: str
    low: tuple[float, ...]
    width: tuple[float, ...]

    @property
    def n_numeric(self) -> int:
        return len(self.schema.numeric)

    @property
    def n_categorical(self) -> int:
        return len(self.schema.categorical)

    @property
    def names(self) -> list[str]:
        return [*(f"n{k}" for k in range(self.n_numeric)), *(f"c{k}" for k in range(self.n_categorical))]

    def of(self, df: DataFrame, row: str, keep: str = "row_id") -> DataFrame:
        scaled = [(q(c) - F.lit(a)) / F.lit(w) if w else F.when(q(c).isNotNull(), 0.0) for c, a, w in zip(self.schema.numeric, self.low, self.width)]
        if self.metric == "cosine" and scaled:
            norm = F.sqrt(sum((x * x for x in scaled), F.lit(0.0)))
            scaled = [F.when(norm > 0, x / norm).otherwise(0.0) for x in scaled]
        return df.select(q(row).alias(keep), *(x.cast("double").alias(f"n{k}") for k, x in enumerate(scaled)), *(q(c).alias(f"c{k}") for k, c in enumerate(self.schema.categorical)))


def prepare(original: DataFrame, schema: AnalysisSchema, metric: str = "gower") -> Features:
    """Scaling by the original alone: ranges for gower, means and population deviations for cosine."""
    if metric not in METRICS:
        raise ValueError(f"unknown distance metric {metric!r}")
    if not schema.columns:
        raise ValueError("no columns to compare")
    names = schema.numeric
    if not names:
        return Features(schema, metric, (), ())
    if metric == "gower":
        row = original.agg(*(F.min(q(c)) for c in names), *(F.max(q(c)) for c in names)).first()
        low = [float(x) if x is not None else 0.0 for x in row[: len(names)]]
        width = [float(b) - a if b is not None else 0.0 for a, b in zip(low, row[len(names) :])]
    else:
        row = original.agg(*(F.avg(q(c)) for c in names), *(F.stddev_pop(q(c)) for c in names), *(F.count_if(q(c).isNull()) for c in names)).first()
        if any(row[2 * len(names) :]):
            raise ValueError("the cosine distance takes no missing numbers")
        low = [x or 0.0 for x in row[: len(names)]]
        width = [x or 1.0 for x in row[len(names) : 2 * len(names)]]
    return Features(schema, metric, tuple(low), tuple(width))


def reject_missing(df: DataFrame, schema: AnalysisSchema) -> None:
    """The cosine kernel takes no missing numbers; one short-circuiting job."""
    for c in schema.numeric:
        if not df.where(q(c).isNull()).isEmpty():
            raise ValueError(f"missing numbers in {c!r}: the cosine distance takes none")


def pair_key(f: Features, a: str = "a", b: str = "b") -> Column:
    """The distance of aliased rows ``a`` and ``b`` as an integer of 1e-12; INFINITE where nothing is comparable."""
    n, c = range(f.n_numeric), range(f.n_categorical)
    miss = sum((F.when(F.col(f"{a}.c{k}").eqNullSafe(F.col(f"{b}.c{k}")), 0).otherwise(1) for k in c), F.lit(0))
    if f.metric == "gower":
        gaps = [F.abs(F.col(f"{a}.n{k}") - F.col(f"{b}.n{k}")) for k in n]
        over = sum((F.when(g.isNull(), 0).otherwise(1) for g in gaps), F.lit(f.n_categorical))
        d = F.try_divide(sum((F.coalesce(g, F.lit(0.0)) for g in gaps), F.lit(0.0)) + miss, over)
    else:
        dot = sum((F.col(f"{a}.n{k}") * F.col(f"{b}.n{k}") for k in n), F.lit(0.0))
        d = 1 - (2 * (f.n_categorical - miss) - f.n_categorical + f.n_numeric * dot) / (f.n_numeric + f.n_categorical)
    return F.coalesce(F.rint(d * SCALE).cast("bigint"), F.lit(INFINITE))


def block_keys(f: Features, qn: np.ndarray, qc: np.ndarray, tn: np.ndarray, tc: np.ndarray) -> np.ndarray:
    """The same for all pairs of two blocks: numbers as float arrays, categories as integer codes."""
    miss = np.zeros((len(qn), len(tn)))
    for k in range(f.n_categorical):
        miss += qc[:, k, None] != tc[None, :, k]
    if f.metric == "cosine":
        dot = qn @ tn.T if f.n_numeric else 0.0
        return np.rint((1 - (2 * (f.n_categorical - miss) - f.n_categorical + f.n_numeric * dot) / (f.n_numeric + f.n_categorical)) * SCALE).astype(np.int64)
    total, over = miss, np.full(miss.shape, float(f.n_categorical))
    for k in range(f.n_numeric):
        gap = np.abs(qn[:, k, None] - tn[None, :, k])
        known = ~np.isnan(gap)
        total = total + np.where(known, gap, 0.0)
        over += known
    with np.errstate(divide="ignore", invalid="ignore"):
        key = np.rint(total / over * SCALE)
    return np.where(over > 0, key, INFINITE).astype(np.int64)
