"""Thresholds from the original table alone: repeated random halves, or a normal approximation.

A row keeps one bit a simulation (``halves``), and every metric but those given as a function
takes all simulations in the same passes over the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import Features
from ..functions.schema import AnalysisSchema, q
from ..functions.stats import normal_threshold
from ..sources.workers import ship_package
from . import halves
from .association import constant_columns, difference_value
from .half_association import half_associations
from .half_neighbours import half_neighbours
from .half_propensity import half_pmse
from .halves import split_in_a
from .propensity import PARAMETERS, pmse, propensity_scores

METRICS = ("univariate_similarity", "bivariate_similarity", "pmse", "single_out_risk", "inference_risk", "linkage_risk")
METHODS = ("simulation", "distribution", "user_defined")
#: Which methods give a metric's threshold.
SUPPORTED = {
    "bivariate_similarity": ("simulation", "user_defined"),
    "pmse": ("simulation", "user_defined"),
    "single_out_risk": METHODS,
    "inference_risk": METHODS,
}
#: single_out_risk passes on value <= threshold, all others on value < threshold.
PASS_RULES = {m: ("<=" if m == "single_out_risk" else "<") for m in METRICS}
NEIGHBOURS = 64


def check_method(metric: str, method: str) -> None:
    if method not in SUPPORTED.get(metric, ()):
        raise ValueError(f"--method {method} is not supported for metric '{metric}'")


def derive_seeds(seed: int, n: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(0, 2**31 - 1, n)]


def splits(original: DataFrame, n: int | None, seeds: Sequence[int]) -> DataFrame:
    """sim, row_id, in_a.

    With n: halves of seeded permutations of row ids 0 to n-1, each made by one task.
    Without: rows of any id, each dealt by a hash of the simulation's seed and its id,
    which needs no task to know all rows; the sides are then only about equal.
    """
    spark = original.sparkSession
    if n is None:
        seeded = F.array(*(F.struct(F.lit(k).alias("sim"), F.lit(s).cast("long").alias("seed")) for k, s in enumerate(seeds)))
        dealt = original.select("row_id", F.explode(seeded).alias("s"))
        return dealt.select("s.sim", "row_id", (F.md5(F.concat(F.col("s.seed").cast("string"), F.lit(":"), F.col("row_id").cast("string"))) < "8").alias("in_a"))
    ship_package(spark)
    table = spark.createDataFrame([(k, s) for k, s in enumerate(seeds)], "sim int, seed long").repartition(len(seeds), "sim")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sim, seed in frame.itertuples(index=False):
                yield pd.DataFrame({"sim": np.int32(sim), "row_id": np.arange(n), "in_a": split_in_a(n, seed)})

    return table.mapInPandas(run, "sim int, row_id long, in_a boolean")


def simulate_single_out(original: DataFrame, columns: Sequence[str], n: int | None, seeds: Sequence[int], by_duplicates: bool = True) -> DataFrame:
    """sim, value: half B against half A.  A record is known by 128 bits of hashes of its values."""
    sims = len(seeds)
    key = original.select("row_id", F.xxhash64(*(F.coalesce(q(c).cast("string"), F.lit("\0")) for c in columns)).alias("g"), F.xxhash64(F.lit(1), *(F.coalesce(q(c).cast("string"), F.lit("\0")) for c in columns)).alias("g2"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in halves.chunks(batches):
            g, g2 = (table.column(c).to_numpy() for c in ("g", "g2"))
            order = np.lexsort((g2, g))
            g, g2 = g[order], g2[order]
            at = halves.starts(g, g2)
            a = np.add.reduceat(halves.members(halves.column(table, "halves"), sims)[order], at, axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(g2[at]), pa.array(np.diff(at, append=len(g))), halves.counted(a)], names=["g", "g2", "n", "a"])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, size, any_rows = np.zeros(sims), np.zeros(sims, np.int64), False
        for table in halves.chunks(batches):
            a = halves.counts(halves.column(table, "a"), sims)
            b = table.column("n").to_numpy()[:, None] - a
            hit += np.where(a > 0, b / np.maximum(a, 1) if by_duplicates else b, 0.0).sum(0)
            size += b.sum(0)
            any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sims, dtype=np.int32)), pa.array(hit), pa.array(size)], names=["sim", "hit", "b"])

    groups = halves.summed(halves.with_halves(key, n, seeds).mapInArrow(records, "g long, g2 long, n long, a binary"), ["g", "g2"], sims)
    return groups.mapInArrow(hits, "sim int, hit double, b long").groupBy("sim").agg(F.try_divide(F.sum("hit"), F.sum("b")).alias("value"))


def simulate_inference(original: DataFrame, f: Features, n: int | None, seeds: Sequence[int], neighbours: int = NEIGHBOURS) -> DataFrame:
    """sim, value, n_ties, n_fallbacks.

    ``original``: scaled features; ``n`` as for ``splits``.  Neighbour lists of the whole
    table are made once; in each split a record of B takes the first list entry that
    lies in A, and that one's own reference likewise.  Where a list has none, the pairs
    of that split are searched in full.
    """
    counts, n_fallbacks = half_neighbours(original, f, n, seeds, neighbours if n is None else min(neighbours, n - 1))
    value = F.try_divide(F.col("flags"), F.col("records") - F.col("ties"))
    return counts.select("sim", value.alias("value"), F.col("ties").alias("n_ties"), F.lit(n_fallbacks).alias("n_fallbacks"))


def simulate_bivariate(original: DataFrame, schema: AnalysisSchema, n: int | None, seeds: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """(sim, value; the constant columns of the whole original, which are left out)."""
    constant = constant_columns(original, schema.columns)
    used = schema.subset([c for c in schema.columns if c not in constant])
    if len(used.columns) < 2:
        raise ValueError("fewer than two columns to compare")
    pairs = half_associations(original, used, n, seeds)
    return difference_value(pairs, len(used.columns), group=["sim"]).select("sim", "value"), constant


def simulate(original: DataFrame, n: int, seeds: Sequence[int], metric_fn: Callable[[DataFrame, DataFrame, int], float | None]) -> list[tuple[int, float | None]]:
    """(sim, value) of any metric: ``metric_fn`` gets both halves (with row_id) of each split, and the split's seed.

    The general way, a driver loop over simulations; the other functions here take all
    simulations in the same passes instead.
    """
    out = []
    for sim, seed in enumerate(seeds):
        side = splits(original, n, [seed]).select("row_id", "in_a")
        halves = (original.join(side.where(which), "row_id", "left_semi") for which in ("in_a", "not in_a"))
        out.append((sim, metric_fn(*halves, seed)))
    return out


def simulate_pmse(original: DataFrame, schema: AnalysisSchema, n: int, seeds: Sequence[int], model: str = "logistic_regression", params: dict | None = None) -> list[tuple[int, float]]:
    """(sim, value): one model per simulation.

    Logistic models are fitted for all simulations in the same passes over the table, as
    long as a system fits a task; trees and larger systems are a driver loop over fits,
    each of which is distributed.
    """
    known = params or {}
    if model == "logistic_regression" and set(known) <= set(PARAMETERS[model]):
        values = half_pmse(original, schema, n, seeds, **{k: v for k, v in known.items() if v is not None})
        if values is not None:
            return values
    return simulate(original, n, seeds, lambda a, b, seed: pmse(propensity_scores(a, b, schema, model, params, seed, "row_id")).first()["value"])


def simulation_summary(values: DataFrame, quantile: float) -> DataFrame:
    """One row: n_valid, n_invalid, mean, std (sample), min, max, quantile_value (exact, interpolated)."""
    v = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return values.agg(F.count(v).alias("n_valid"), (F.count("*") - F.count(v)).alias("n_invalid"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, quantile).alias("quantile_value"))


def distribution_threshold(p: float, n: int, quantile: float) -> dict:
    return normal_threshold(p, n, quantile)


def corrected(values: DataFrame) -> DataFrame:
    """Adds p_star, the size-corrected share."""
    return values.withColumn("p_star", 1 - F.pow(1 - F.col("value"), 2))


def judge(metric: str, value: float | None, record: dict | None, parameters: dict | None = None) -> dict:
    """Verdict fields of a metric value under a threshold record."""
    if record is None:
        return {"threshold": None, "threshold_source": None, "threshold_file": None, "passed": None}
    threshold = record["threshold"]
    passed = None
    if value is not None and threshold is not None:
        passed = value <= threshold if PASS_RULES[metric] == "<=" else value < threshold
    out = {"threshold": threshold, "threshold_source": record.get("threshold_source"), "threshold_file": record.get("threshold_file"), "pass_rule": f"value {PASS_RULES[metric]} threshold", "passed": passed}
    warnings = []
    if record.get("threshold_source") != "user_defined":
        ours, theirs = parameters or {}, record.get("parameters", {})
        for name in ("duplicate_adjustment", "model", "model_params"):
            if name in ours and name in theirs and ours[name] != theirs[name]:
                warnings.append(f"{name} differs: {theirs[name]!r} for the threshold, {ours[name]!r} for the metric")
        if metric == "single_out_risk" and theirs.get("method") == "simulation" and theirs.get("size_correction", "on") != "on":
            warnings.append("the threshold has no size correction")
    return out | ({"judge_warnings": warnings} if warnings else {})

