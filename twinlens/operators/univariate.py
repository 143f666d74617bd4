"""Univariate similarity: two-sample Kolmogorov-Smirnov and chi-square homogeneity per column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import AnalysisSchema, q
from ..functions.stats import chi2_tail, ks_tail
from .association import chi_square

GRID, RANGES, TOGETHER = 50, 64, 16


def _long(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, synthetic (0 or 1) of every known value."""
    rows = F.array(*(F.struct(F.lit(c).alias("column"), q(c).alias("value")) for c in columns))
    side = lambda df, s: df.select(F.inline(rows), F.lit(s).alias("synthetic"))
    return side(original, 0).unionByName(side(synthetic, 1)).where("value is not null")


def level_counts(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n_o, n_s: one combined shuffle of distinct values."""
    return _long(original, synthetic, columns).groupBy("column", "value").agg(F.count_if(F.col("synthetic") == 0).alias("n_o"), F.count_if(F.col("synthetic") == 1).alias("n_s"))


def ks_statistics(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, statistic, n_o, n_s; the statistic is NULL where a side has no value.

    Running sums go over distinct values.  They are summed in ranges first, so that no
    task holds a whole column: each range is shifted by what lies before it.
    """
    counts = level_counts(original, synthetic, columns)
    # Ranges end at quantiles of the distinct values, so an outlier leaves them about equally full.
    cuts = F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)
    bounds = counts.groupBy("column").agg(cuts.alias("cuts"), F.sum("n_o").alias("m"), F.sum("n_s").alias("n"))
    # A row per column.
    placed = counts.join(F.broadcast(bounds), "column").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sums = placed.groupBy("column", "part").agg(F.sum("n_o").alias("po"), F.sum("n_s").alias("ps"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = sums.select("column", "part", F.coalesce(F.sum("po").over(before), F.lit(0)).alias("bo"), F.coalesce(F.sum("ps").over(before), F.lit(0)).alias("bs"))
    upto = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(F.broadcast(shifted), ["column", "part"])
    gap = F.abs(F.try_divide(F.col("bo") + F.sum("n_o").over(upto), F.col("m")) - F.try_divide(F.col("bs") + F.sum("n_s").over(upto), F.col("n")))
    return run.withColumn("gap", gap).groupBy("column").agg(F.max("gap").alias("statistic"), F.max("m").alias("n_o"), F.max("n").alias("n_s"))


def chi2_statistics(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, statistic, dof, n_categories of the 2 x k table of levels."""
    counts = level_counts(original, synthetic, columns)
    cells = counts.select("column", F.inline(F.array(F.struct(F.lit("o").alias("a"), F.col("value").alias("b"), F.col("n_o").alias("n")), F.struct(F.lit("s").alias("a"), F.col("value").alias("b"), F.col("n_s").alias("n"))))).where("n > 0")
    return chi_square(cells, ["column"]).select("column", "statistic", (F.col("cols") - 1).alias("dof"), F.col("cols").alias("n_categories"))


def ecdf_grid(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], points: int = GRID) -> DataFrame:
    """column, point, x, ecdf_o, ecdf_s: right-continuous ECDFs at even points of the original's range; one aggregation a side for ``TOGETHER`` columns."""
    ranges = original.agg(*(F.struct(F.min(q(c)).alias("lo"), F.max(q(c)).alias("hi")).alias(f"c{k}") for k, c in enumerate(columns))).first()
    grids = {}
    for k, c in enumerate(columns):
        lo, hi = ranges[f"c{k}"]["lo"], ranges[f"c{k}"]["hi"]
        if lo is not None:
            grids[c] = [float(x) for x in [lo + (hi - lo) * i / (points - 1) for i in range(points - 1)] + [hi]]
    table = original.sparkSession.createDataFrame([(c, i, x) for c, xs in grids.items() for i, x in enumerate(xs)], "column string, point int, x double")

    def side(df: DataFrame, name: str) -> DataFrame:
        out = []
        for at in range(0, len(grids), TOGETHER):
            some = list(grids.items())[at : at + TOGETHER]
            shares = df.agg(*(F.array(*(F.try_divide(F.count_if(q(c) <= x), F.count(q(c))) for x in xs)).alias(f"y{k}") for k, (c, xs) in enumerate(some)))
            rows = shares.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"y{k}").alias("y")) for k, (c, _) in enumerate(some)))))
            out.append(rows.select("column", F.posexplode("y").alias("point", name)))
        return reduce(DataFrame.unionByName, out)

    if not grids:
        return table.select("column", "point", "x", F.lit(None).cast("double").alias("ecdf_o"), F.lit(None).cast("double").alias("ecdf_s"))
    return table.join(side(original, "ecdf_o"), ["column", "point"]).join(side(synthetic, "ecdf_s"), ["column", "point"])


def category_bars(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, percent_o, percent_s of each level."""
    w = Window.partitionBy("column")
    share = lambda n: F.coalesce(F.try_divide(100 * F.col(n), F.sum(n).over(w)), F.lit(0.0))
    return level_counts(original, synthetic, columns).select("column", "value", share("n_o").alias("percent_o"), share("n_s").alias("percent_s"))


def univariate_similarity(original: DataFrame, synthetic: DataFrame, schema: AnalysisSchema, alpha: float = 0.05) -> dict:
    """value None; per column the test, its statistic and p-value; how many are significant."""
    variables: dict[str, dict] = {}
    if schema.numeric:
        for r in ks_statistics(original, synthetic, schema.numeric).collect():  # one row per column
            p = None if r["statistic"] is None else ks_tail(r["statistic"], r["n_o"], r["n_s"])
            variables[r["column"]] = {"test": "ks", "type": "numeric", "statistic": r["statistic"], "p_value": p}
    if schema.categorical:
        for r in chi2_statistics(original, synthetic, schema.categorical).collect():
            p = 1.0 if r["dof"] == 0 else chi2_tail(r["statistic"], r["dof"])
            variables[r["column"]] = {"test": "chi2", "type": "categorical", "statistic": r["statistic"], "p_value": p, "dof": r["dof"], "n_categories": r["n_categories"]}
    for c in schema.columns:
        variables.setdefault(c, {"test": "ks" if c in schema.numeric else "chi2", "type": "numeric" if c in schema.numeric else "categorical", "statistic": None, "p_value": None, "note": "no values"})
    significant = sum(v["p_value"] is not None and v["p_value"] < alpha for v in variables.values())
    return {"value": None, "details": {"alpha": alpha, "n_variables": len(variables), "n_significant": significant, "variables": {c: variables[c] for c in schema.columns}}}


def test_text(v: dict) -> str:
    name = "KS test" if v["test"] == "ks" else "Chi-square test"
    if v["statistic"] is None:
        return f"{name}: {v.get('note', 'not computed')}"
    return f"{name}: statistic={v['statistic']:.4f}, p-value={v['p_value']:.4f}"


