"""Analysis schema: two logical types, and the coercions that follow from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SAMPLES = 10


class DataValidationError(ValueError):
    """The tables can't be compared as they are."""


@dataclass(frozen=True)
class AnalysisSchema:
    columns: tuple[str, ...]
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]

    def subset(self, keep: Sequence[str]) -> AnalysisSchema:
        pick = lambda names: tuple(c for c in names if c in set(keep))
        return AnalysisSchema(pick(self.columns), pick(self.categorical), pick(self.numeric))


def is_numeric(kind: T.DataType) -> bool:
    """Integers and floats; booleans and decimals are categories."""
    return isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType)


def exclude_columns(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` without ``names``, and those of them that it hasn't."""
    return df.drop(*names), [c for c in names if c not in df.columns]


def infer_schema(df: DataFrame, forced_categorical: Sequence[str] = ()) -> AnalysisSchema:
    """Logical types from the original's physical ones."""
    if len(set(forced_categorical)) != len(forced_categorical):
        raise DataValidationError(f"duplicate categorical columns: {sorted(forced_categorical)}")
    if unknown := [c for c in forced_categorical if c not in df.columns]:
        raise DataValidationError(f"unknown categorical columns: {unknown}")
    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise DataValidationError(f"column {f.name!r} has type {f.dataType.simpleString()}, which is neither a number nor a category")
    numeric = tuple(f.name for f in df.schema if is_numeric(f.dataType) and f.name not in forced_categorical)
    return AnalysisSchema(tuple(df.columns), tuple(c for c in df.columns if c not in numeric), numeric)


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, so that there is one missing value."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*(F.when(~F.isnan(q(c)), q(c)).alias(c) if c in floats else q(c) for c in df.columns)) if floats else df


def category_text(df: DataFrame, name: str, whole: bool) -> Column:
    """A value of a categorical column as text; ``whole``: all numbers of this frame's column are integral."""
    kind, c = df.schema[name].dataType, q(name)
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("bigint").cast("string") if whole else c.cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return c.cast("string")


def coerce(df: DataFrame, schema: AnalysisSchema) -> DataFrame:
    """Categories as text, numbers as doubles, in the schema's order.

    One job over the frame: which float categories are whole, and whether a numeric
    column holds text that is no number (an error that shows up to ten values).
    """
    df = without_nan(df)
    floats = [c for c in schema.categorical if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    texts = [c for c in schema.numeric if not is_numeric(df.schema[c].dataType)]
    whole: dict[str, bool] = {}
    if floats or texts:
        bad = {c: q(c).isNotNull() & q(c).try_cast("double").isNull() for c in texts}
        checks = [F.coalesce(F.bool_and(q(c) % 1 == 0), F.lit(True)).alias(f"w{k}") for k, c in enumerate(floats)]
        checks += [F.count_if(bad[c]).alias(f"b{k}") for k, c in enumerate(texts)]
        row = df.agg(*checks).first()
        whole = {c: row[f"w{k}"] for k, c in enumerate(floats)}
        least = lambda c: [r[0] for r in df.where(bad[c]).select(q(c).cast("string").alias("v")).distinct().orderBy("v").limit(MAX_SAMPLES).collect()]
        if failed := {c: least(c) for k, c in enumerate(texts) if row[f"b{k}"]}:
            raise DataValidationError(f"values that are no numbers: {failed}")
    return df.select(*(category_text(df, c, whole.get(c, False)).alias(c) if c in schema.categorical else q(c).try_cast("double").alias(c) for c in schema.columns))


def contiguous_ids(df: DataFrame, key: str, name: str = "row_id", ranges: int = 64) -> DataFrame:
    """Row numbers from 0 in the order of a unique numeric ``key``, without one task seeing all rows.

    The key's range is cut at approximate quantiles, which become literals; each range
    is numbered by itself and shifted by the number of rows before it.
    """
    from pyspark.sql import Window

    cuts = sorted(set(df.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.01)))
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: q(key).cast("double") > c))
    cut = df.withColumn("__part", part)
    sizes = {r["__part"]: r["count"] for r in cut.groupBy("__part").count().collect()}
    before, total = [], 0
    for k in range(len(cuts) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    offset = F.get(F.array(*(F.lit(b).cast("long") for b in before)), F.col("__part"))
    return cut.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(q(key))) - 1 + offset).drop("__part")
