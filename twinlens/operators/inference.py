"""Inference risk: is a synthetic record nearer to an original than that original's own neighbour?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import INFINITE, SCALE, Features
from .neighbours import k_nearest, nearest


def as_distance(key: str) -> Column:
    return F.when(F.col(key) == INFINITE, F.lit(float("inf"))).otherwise(F.col(key) / F.lit(SCALE))


def inference_records(original: DataFrame, synthetic: DataFrame, f: Features) -> DataFrame:
    """row_id, nearest_index, nearest_distance, reference_distance, flag, tie per synthetic record.

    Both frames are scaled features.  The reference distance, from the chosen original
    to its nearest other original, is worked out for chosen originals only.
    """
    near = nearest(synthetic, original, f)
    chosen = original.join(near.select(F.col("neighbour").alias("row_id")).distinct(), "row_id", "left_semi")
    reference = nearest(chosen, original, f, not_itself=True).select(F.col("row_id").alias("neighbour"), F.col("dkey").alias("rkey"))
    both = near.join(reference, "neighbour", "left").withColumn("rkey", F.coalesce("rkey", F.lit(INFINITE)))
    return both.select("row_id", F.col("neighbour").alias("nearest_index"), as_distance("dkey").alias("nearest_distance"), as_distance("rkey").alias("reference_distance"), (F.col("dkey") < F.col("rkey")).alias("flag"), (F.col("dkey") == F.col("rkey")).alias("tie"))


def inference_risk(records: DataFrame) -> DataFrame:
    """One row: value, n_flagged, n_evaluated, n_ties.  Ties count nowhere but in n_ties."""
    flagged, tied = F.count_if("flag"), F.count_if("tie")
    return records.agg(F.try_divide(flagged, F.count("*") - tied).alias("value"), flagged.alias("n_flagged"), (F.count("*") - tied).alias("n_evaluated"), tied.alias("n_ties"))


def distance_summary(records: DataFrame, column: str) -> DataFrame:
    """mean, min, median, max of the finite values."""
    x = records.where(F.col(column) < float("inf"))
    return x.agg(F.avg(column).alias("mean"), F.min(column).alias("min"), F.percentile(column, 0.5).alias("median"), F.max(column).alias("max"))


def distribution_share(original: DataFrame, f: Features) -> DataFrame:
    """One row: p, n_evaluated, n_ties over the original alone.

    For each original r its nearest other r1 at d1, and r1's nearest original that is
    not r at d2; r is flagged if d1 < d2, and a tie if they are equal.
    """
    two = k_nearest(original, original, f, 2, not_itself=True)
    one = two.where("pos = 0").select("row_id", F.col("neighbour").alias("r1"), F.col("dkey").alias("d1"))
    back = two.select(F.col("row_id").alias("r1"), F.col("neighbour").alias("r2"), F.col("dkey").alias("d2"))
    d2 = one.join(back, "r1").where("r2 <> row_id").groupBy("row_id", "d1").agg(F.min("d2").alias("d2"))
    tie, flag = F.count_if(F.col("d1") == F.col("d2")), F.count_if(F.col("d1") < F.col("d2"))
    return d2.agg(F.try_divide(flag, F.count("*") - tie).alias("p"), (F.count("*") - tie).alias("n_evaluated"), tie.alias("n_ties"))
