"""Exact matches between a synthetic and an original table: singling-out risk.

No join: both tables are united with a side flag and grouped by all columns (NULLs
are equal there), so matching costs one partially combined shuffle of distinct rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import q


def record_groups(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct records with n_o and n_s, how often each side has them."""
    one = original.select(*(q(c) for c in columns), F.lit(1).alias("__o"), F.lit(0).alias("__s"))
    two = synthetic.select(*(q(c) for c in columns), F.lit(0).alias("__o"), F.lit(1).alias("__s"))
    return one.unionByName(two).groupBy(*(q(c) for c in columns)).agg(F.sum("__o").alias("n_o"), F.sum("__s").alias("n_s"))


def risk_columns(by_duplicates: bool) -> Column:
    """Share of synthetic records found in the original; each match counts 1/d for d equal originals if ``by_duplicates``."""
    hit = F.col("n_s") / F.col("n_o") if by_duplicates else F.col("n_s").cast("double")
    return F.try_divide(F.sum(F.when(F.col("n_o") > 0, hit).otherwise(0.0)), F.sum("n_s"))


def single_out_risk(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], by_duplicates: bool = True) -> DataFrame:
    """One row: value, n_matched_records, matched_ratio, n_original_duplicate_records, n_synthetic."""
    groups = record_groups(original, synthetic, columns)
    matched = F.sum(F.when(F.col("n_o") > 0, F.col("n_s")).otherwise(0))
    return groups.agg(
        risk_columns(by_duplicates).alias("value"),
        matched.alias("n_matched_records"),
        F.try_divide(matched, F.sum("n_s")).alias("matched_ratio"),
        F.sum(F.when(F.col("n_o") > 1, F.col("n_o")).otherwise(0)).alias("n_original_duplicate_records"),
        F.sum("n_s").alias("n_synthetic"),
    )


def leave_one_out(original: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: p_equation_1, p_equation_2, n: every original record against all others."""
    n = original.groupBy(*(q(c) for c in columns)).agg(F.count("*").alias("n"))
    share = lambda hit: F.try_divide(F.sum(F.when(F.col("n") > 1, hit).otherwise(0.0)), F.sum("n"))
    return n.agg(share(F.col("n").cast("double")).alias("p_equation_1"), share(F.col("n") / (F.col("n") - 1)).alias("p_equation_2"), F.sum("n").alias("n"))


def without_exact_matches(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Synthetic rows that equal no original row, NULL equal to NULL."""
    known = original.select(*(q(c).alias(f"__k{i}") for i, c in enumerate(columns))).distinct()
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & q(c).eqNullSafe(F.col(f"__k{i}"))
    return synthetic.join(known, same, "left_anti")
