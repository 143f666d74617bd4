"""Association of columns: Pearson, ANOVA R-squared, Cramer's V, and how two tables differ in them.

Every kind of pair takes one job over the table: numeric pairs as one aggregation of
moments, mixed and categorical pairs from one unpivoted grouping each.  ``group``
columns (a side, a simulation) ride along as extra keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import AnalysisSchema, q


def _none(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.select(*group, F.lit("").alias("column_1"), F.lit("").alias("column_2"), F.lit("").alias("method"), F.lit(0.0).alias("value")).limit(0)


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], group: Sequence[str] = ()) -> DataFrame:
    """value over the rows where both are known; NULL where one is constant there."""
    if not pairs:
        return _none(df, group)
    out = []
    for a, b in pairs:
        x, y = F.when(q(b).isNotNull(), q(a)), F.when(q(a).isNotNull(), q(b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        out.append(F.when(spread > 0, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))))
    wide = df.groupBy(*group).agg(*(v.alias(f"v{k}") for k, v in enumerate(out)))
    rows = F.array(*(F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.lit("pearson").alias("method"), F.col(f"v{k}").alias("value")) for k, (a, b) in enumerate(pairs)))
    return wide.select(*group, F.inline(rows))


def level_moments(df: DataFrame, pairs: Sequence[tuple[str, str]], group: Sequence[str] = ()) -> DataFrame:
    """category, number, level, n, mean, ss (squares about the level's mean) of known pairs."""
    rows = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(x).alias("number"), q(c).alias("level"), q(x).alias("y")) for c, x in pairs))
    long = df.select(*group, F.inline(rows)).where("level is not null and y is not null")
    return long.groupBy(*group, "category", "number", "level").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("*")).alias("ss"))


def anova_r2(df: DataFrame, pairs: Sequence[tuple[str, str]], group: Sequence[str] = ()) -> DataFrame:
    """Share of a number's variation that a category explains; NULL where there is none."""
    if not pairs:
        return _none(df, group)
    m = level_moments(df, pairs, group)
    # Levels are few next to rows; their grand mean is a window over them.
    grand = Window.partitionBy(*group, "category", "number")
    joined = m.withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(grand) / F.sum("n").over(grand))
    between = joined.groupBy(*group, "category", "number").agg(F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between"), F.sum("ss").alias("within"))
    whole = F.col("between") + F.col("within")
    return between.select(*group, F.col("category").alias("column_1"), F.col("number").alias("column_2"), F.lit("anova_r2").alias("method"), F.when(whole > 0, F.col("between") / F.nullif(whole, F.lit(0.0))).alias("value"))


def ols_coefficients(df: DataFrame, category: str, number: str) -> DataFrame:
    """name, coefficient of the one-way model: the first level's mean, and the others' differences from it."""
    m = level_moments(df, [(category, number)])
    first = m.agg(F.min_by("mean", "level").alias("base"), F.min("level").alias("first"))
    both = m.crossJoin(F.broadcast(first))  # one row
    name = F.when(F.col("level") == F.col("first"), F.lit("Intercept")).otherwise(F.concat(F.lit(f"{category}[T."), "level", F.lit("]")))
    return both.select(name.alias("name"), F.when(F.col("level") == F.col("first"), F.col("mean")).otherwise(F.col("mean") - F.col("base")).alias("coefficient"), "n")


def chi_square(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """statistic, n, rows, cols of the tables (a, b, n) under each of ``keys``, with Yates' correction at one degree of freedom."""
    ra = counts.groupBy(*keys, "a").agg(F.sum("n").alias("ra"))
    rb = counts.groupBy(*keys, "b").agg(F.sum("n").alias("rb"))
    size = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.count_distinct("a").alias("rows"), F.count_distinct("b").alias("cols"))
    cells = counts.join(ra, [*keys, "a"]).join(rb, [*keys, "b"]).join(size, list(keys))
    expected = F.col("ra") * F.col("rb") / F.col("total")
    # Empty cells have no row here: sum (O-E)^2/E = sum O^2/E - n holds over the others.
    plain = cells.groupBy(*keys, "rows", "cols", "total").agg(F.sum(F.col("n") * F.col("n") / expected).alias("s"), F.max(F.abs(F.col("n") - expected)).alias("gap"))
    marg = ra.groupBy(*keys).agg(F.min("ra").alias("ra1"), F.max("ra").alias("ra2")).join(rb.groupBy(*keys).agg(F.min("rb").alias("rb1"), F.max("rb").alias("rb2")), list(keys))
    t = F.col("total").cast("double")
    four = t * t * (1 / F.nullif(F.col("ra1").cast("double") * F.col("ra2"), F.lit(0.0))) * (1 / F.nullif(F.col("rb1").cast("double") * F.col("rb2"), F.lit(0.0))) * t
    shrunk = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    yates = shrunk * shrunk * four
    degenerate = (F.col("rows") < 2) | (F.col("cols") < 2)
    value = F.when(degenerate, F.lit(0.0)).when((F.col("rows") == 2) & (F.col("cols") == 2), yates).otherwise(F.greatest(F.col("s") - t, F.lit(0.0)))
    return plain.join(marg, list(keys)).select(*keys, value.alias("statistic"), F.col("total").alias("n"), "rows", "cols")


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]], group: Sequence[str] = ()) -> DataFrame:
    """value over the rows where both are known; NULL where one has fewer than two levels there."""
    if not pairs:
        return _none(df, group)
    rows = F.array(*(F.struct(F.lit(x).alias("column_1"), F.lit(y).alias("column_2"), q(x).alias("a"), q(y).alias("b")) for x, y in pairs))
    counts = df.select(*group, F.inline(rows)).where("a is not null and b is not null").groupBy(*group, "column_1", "column_2", "a", "b").agg(F.count("*").alias("n"))
    keys = [*group, "column_1", "column_2"]
    least = F.least("rows", "cols") - 1
    v = F.when(least > 0, F.sqrt(F.col("statistic") / F.col("n") / F.nullif(least, F.lit(0))))
    return chi_square(counts, keys).select(*keys, F.lit("cramers_v").alias("method"), v.alias("value"))


def column_pairs(schema: AnalysisSchema) -> tuple[list, list, list]:
    return list(combinations(schema.numeric, 2)), list(product(schema.categorical, schema.numeric)), list(combinations(schema.categorical, 2))


def associations(df: DataFrame, schema: AnalysisSchema, group: Sequence[str] = ()) -> DataFrame:
    """column_1, column_2, method, value of every pair of columns."""
    nn, cn, cc = column_pairs(schema)
    return reduce(DataFrame.unionByName, [pearson(df, nn, group), anova_r2(df, cn, group), cramers_v(df, cc, group)])


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most one value, a missing one counting as a value; one job."""
    row = df.agg(F.count("*").alias("n"), *(F.struct((F.min(q(c)) == F.max(q(c))).alias("same"), F.count(q(c)).alias("known")).alias(f"c{k}") for k, c in enumerate(columns))).first()
    return [c for k, c in enumerate(columns) if row[f"c{k}"]["known"] == 0 or (row[f"c{k}"]["same"] and row[f"c{k}"]["known"] == row["n"])]


def difference_value(pairs: DataFrame, n_columns: int, left: str = "original", right: str = "synthetic", group: Sequence[str] = ()) -> DataFrame:
    """Population deviation over all n*n entries of the difference of two symmetric matrices (zero diagonals)."""
    d = F.col(left) - F.col(right)
    n2 = float(n_columns * n_columns)
    known = F.count_if(d.isNull()) == 0
    mean = 2 * F.sum(d) / n2
    return pairs.groupBy(*group).agg(F.when(known, F.sqrt(F.greatest(2 * F.sum(d * d) / n2 - mean * mean, F.lit(0.0)))).alias("value"), F.count_if(d.isNull()).alias("n_nan_pairs"))


def bivariate_pairs(original: DataFrame, synthetic: DataFrame, schema: AnalysisSchema) -> DataFrame:
    """column_1, column_2, method, original, synthetic, difference."""
    o = associations(original, schema).withColumnRenamed("value", "original")
    s = associations(synthetic, schema).withColumnRenamed("value", "synthetic")
    return o.join(s, ["column_1", "column_2", "method"], "full").withColumn("difference", F.col("original") - F.col("synthetic"))


def bivariate_similarity(original: DataFrame, synthetic: DataFrame, schema: AnalysisSchema, drop_constant: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """(one row: value, n_nan_pairs, n_columns_used; the pairs; the constant columns left out)."""
    constant = sorted({*constant_columns(original, schema.columns), *constant_columns(synthetic, schema.columns)}) if drop_constant else []
    used = schema.subset([c for c in schema.columns if c not in constant])
    if len(used.columns) < 2:
        raise ValueError("fewer than two columns to compare")
    pairs = bivariate_pairs(original, synthetic, used)
    return difference_value(pairs, len(used.columns)).withColumn("n_columns_used", F.lit(len(used.columns))), pairs, constant

