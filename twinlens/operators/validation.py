"""Pair validation: schema differences, and what the synthetic data has that the original hasn't."""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import MAX_SAMPLES, AnalysisSchema, DataValidationError, coerce, exclude_columns, infer_schema, is_numeric, q, without_nan
from .association import constant_columns

log = logging.getLogger("twinlens")

#: Texts that often stand for a missing value.
MISSING_LIKE = ["", " ", "NA", "N/A", "na", "n/a", "null", "NULL", "None", "none", "nan", "NaN", "?", "-"]


def name_diff(original: Sequence[str], synthetic: Sequence[str]) -> None:
    for side, names in (("original", original), ("synthetic", synthetic)):
        if twice := sorted(c for c, n in Counter(names).items() if n > 1):
            raise DataValidationError(f"duplicate columns in the {side} table: {twice}")
    only_o, only_s = sorted(set(original) - set(synthetic)), sorted(set(synthetic) - set(original))
    if only_o or only_s:
        raise DataValidationError(f"column names differ: only in the original {only_o}, only in the synthetic table {only_s}")


def aligned(synthetic: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, bool]:
    """``synthetic`` in the original's column order, and whether it had another one."""
    return synthetic.select(*(q(c) for c in columns)), list(synthetic.columns) != list(columns)


def type_diff(original: DataFrame, synthetic: DataFrame, forced: Sequence[str]) -> list[dict]:
    """Warnings on differing numeric types; different kinds are an error unless declared categorical."""
    out, bad = [], []
    for c in original.columns:
        a, b = original.schema[c].dataType, synthetic.schema[c].dataType
        if is_numeric(a) != is_numeric(b) and c not in forced:
            bad.append(c)
        elif is_numeric(a) and is_numeric(b) and a != b:
            out.append({"column": c, "warning": "numeric_dtype_differs", "original": a.simpleString(), "synthetic": b.simpleString()})
    if bad:
        raise DataValidationError(f"column types differ: {bad}")
    return out


def _unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns))))


def missing_counts(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_o, n_s of columns with missing values; one aggregation per table."""

    def side(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(*(F.count_if(q(c).isNull()).alias(f"c{k}") for k, c in enumerate(columns)))
        return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias(name)) for k, c in enumerate(columns)))))

    return side(original, "n_o").join(side(synthetic, "n_s"), "column").where("n_o > 0 or n_s > 0")


def missing_like(original: DataFrame, synthetic: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """column, value, n_o, n_s of texts that look like a missing value (blank ones included)."""
    side = lambda df, s: _unpivot(df, categorical).where(F.col("value").isin(MISSING_LIKE) | (F.trim("value") == "")).withColumn("s", F.lit(s))
    return side(original, 0).unionByName(side(synthetic, 1)).groupBy("column", "value").agg(F.count_if(F.col("s") == 0).alias("n_o"), F.count_if(F.col("s") == 1).alias("n_s"))


def levels_without(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_levels, first_levels: known levels of ``left`` that ``right`` hasn't."""
    own = _unpivot(left, columns).where("value is not null").distinct()
    other = _unpivot(right, columns).where("value is not null").distinct()
    lone = own.exceptAll(other)
    # The least levels by rank: no list ever holds more than MAX_SAMPLES.
    first = lone.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("r") <= MAX_SAMPLES)
    shown = first.groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("first_levels"))
    return lone.groupBy("column").agg(F.count("*").alias("n_levels")).join(shown, "column")


def unseen_levels(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    return levels_without(synthetic, original, columns)


def unused_levels(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    return levels_without(original, synthetic, columns)


def out_of_range(original: DataFrame, synthetic: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """column, low, high (the original's range), n_outside (synthetic values beyond it)."""
    bounds = original.agg(*(f(q(c)).alias(f"{p}{k}") for k, c in enumerate(numeric) for p, f in (("lo", F.min), ("hi", F.max))))
    wide = synthetic.crossJoin(F.broadcast(bounds))  # one row
    out = wide.agg(*(F.struct(F.first(f"lo{k}").alias("low"), F.first(f"hi{k}").alias("high"), F.count_if((q(c) < F.col(f"lo{k}")) | (q(c) > F.col(f"hi{k}"))).alias("n_outside")).alias(f"r{k}") for k, c in enumerate(numeric)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"r{k}.low").alias("low"), F.col(f"r{k}.high").alias("high"), F.col(f"r{k}.n_outside").alias("n_outside")) for k, c in enumerate(numeric)))
    return out.select(F.inline(rows)).where("n_outside > 0")


@dataclass
class ValidatedPair:
    original: DataFrame
    synthetic: DataFrame
    raw_synthetic: DataFrame
    schema: AnalysisSchema
    report: dict
    #: All columns, in the original's order.
    file_columns: list[str]


def validate_pair(original: DataFrame, synthetic: DataFrame, forced_categorical: Sequence[str] = (), exclude: Sequence[str] = (), with_format: bool = True) -> ValidatedPair:
    """The coerced, aligned pair with its schema and a report; raises DataValidationError where it can't be compared."""
    name_diff(original.columns, synthetic.columns)
    file_columns = list(original.columns)
    synthetic, reordered = aligned(synthetic, original.columns)
    original, absent = exclude_columns(original, exclude)
    synthetic, _ = exclude_columns(synthetic, exclude)
    if absent:
        log.warning("columns to exclude that are not there: %s", absent)
    forced = [c for c in forced_categorical if c not in exclude]
    schema = infer_schema(original, forced)
    warnings = type_diff(original, synthetic, forced)
    raw_o, raw_s = without_nan(original), without_nan(synthetic)
    o, s = coerce(raw_o, schema), coerce(raw_s, schema)
    report = {
        "passed": True,
        "column_names_match": True,
        "column_order_reordered": reordered,
        "schema": {"columns": list(schema.columns), "categorical": list(schema.categorical), "numeric": list(schema.numeric)},
        "excluded_columns": [c for c in exclude if c not in absent],
        "absent_excluded_columns": absent,
        "type_warnings": warnings,
    }
    if with_format:
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row per column or token
        report["format"] = {
            "missing": rows(missing_counts(o, s, schema.columns)),
            "missing_like": rows(missing_like(raw_o, raw_s, schema.categorical)) if schema.categorical else [],
            "unseen_categories": rows(unseen_levels(o, s, schema.categorical)) if schema.categorical else [],
            "unused_categories": rows(unused_levels(o, s, schema.categorical)) if schema.categorical else [],
            "numeric_out_of_range": rows(out_of_range(o, s, schema.numeric)) if schema.numeric else [],
        }
        report["constant_columns"] = {"original": constant_columns(o, schema.columns), "synthetic": constant_columns(s, schema.columns)}
        report["input_info"] = {"n_original": o.count(), "n_synthetic": s.count(), "n_columns": len(schema.columns)}
    return ValidatedPair(o, s, synthetic, schema, report, file_columns)
