"""Linkage risk by correct attribution probability (CAP).

For an original record with quasi-identifiers K and sensitive attributes T: of the
synthetic records with the same K, the share that has the same T.  Values are
compared as texts.  Counts come from one grouping of the synthetic table per
evaluation; the joins to the original are many-to-one on K and on K and T.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import q

#: Texts that stand for a missing value, case-sensitive.
MISSING = ["", "None", "null", "NULL", "NaN", "nan"]
POLICIES, MODES = ("exclude", "error"), ("individual", "combined")


@dataclass(frozen=True)
class CapOptions:
    quasi_identifiers: tuple[str, ...]
    sensitive: tuple[str, ...]
    threshold: float | None = 0.7
    policy: str = "exclude"
    mode: str = "individual"

    def check(self, columns: Sequence[str]) -> None:
        k, t = self.quasi_identifiers, self.sensitive
        if not k or not t:
            raise ValueError("quasi-identifiers and sensitive attributes must not be empty")
        if set(k) & set(t):
            raise ValueError(f"columns on both sides: {sorted(set(k) & set(t))}")
        if self.threshold is not None and not 0 <= self.threshold <= 1:
            raise ValueError("the threshold lies between 0 and 1")
        if self.policy not in POLICIES or self.mode not in MODES:
            raise ValueError(f"policy is one of {POLICIES}, mode one of {MODES}")
        if absent := [c for c in (*k, *t) if c not in columns]:
            raise ValueError(f"absent columns: {absent}")

    def evaluations(self) -> list[tuple[str, tuple[str, ...]]]:
        out = [(t, (t,)) for t in self.sensitive]
        if self.mode == "combined" and len(self.sensitive) > 1:
            out.append(("+".join(self.sensitive), self.sensitive))
        return out


def as_texts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [F.when(~q(c).cast("string").isin(MISSING), q(c).cast("string")).alias(c) for c in columns]


def cap_records(original: DataFrame, synthetic: DataFrame, options: CapOptions, row: str) -> DataFrame:
    """One row per evaluation and original record: counts, cap (NULL where not evaluated), exceeds, reason."""
    options.check(original.columns)
    options.check(synthetic.columns)
    k = list(options.quasi_identifiers)
    every = [*k, *options.sensitive]
    o = original.select(q(row).alias("original_row"), *as_texts(original, every))
    s = synthetic.select(*as_texts(synthetic, every))
    out = []
    for name, t in options.evaluations():
        pairs = s.dropna(subset=[*k, *t]).groupBy(*(q(c) for c in (*k, *t))).agg(F.count("*").alias("t_count"))
        pairs = pairs.withColumn("k_count", F.sum("t_count").over(Window.partitionBy(*(q(c) for c in k))))
        keys = pairs.select(*(q(c) for c in k), F.col("k_count").alias("key_count")).distinct()
        no_k = reduce(lambda a, b: a | b, (q(c).isNull() for c in k))
        no_t = reduce(lambda a, b: a | b, (q(c).isNull() for c in t))
        reason = F.when(no_k & no_t, "missing_key_and_target").when(no_k, "missing_key").when(no_t, "missing_target").otherwise("")
        joined = o.select("original_row", *(q(c) for c in (*k, *t)), reason.alias("reason")).join(keys, k, "left").join(pairs.select(*(q(c) for c in (*k, *t)), "t_count"), [*k, *t], "left")
        evaluated = F.col("reason") == ""
        count = lambda c: F.when(evaluated, F.coalesce(F.col(c), F.lit(0)))
        cap = F.when(evaluated, F.coalesce(F.try_divide(count("t_count"), count("key_count")), F.lit(0.0)))
        exceeds = F.lit(None).cast("boolean") if options.threshold is None else cap > options.threshold
        out.append(joined.select(F.lit(name).alias("evaluation"), "original_row", evaluated.alias("evaluated"), "reason", count("key_count").alias("key_matches"), count("t_count").alias("target_matches"), cap.alias("cap"), exceeds.alias("exceeds")))
    records = reduce(DataFrame.unionByName, out)
    if options.policy == "error" and not records.where("not evaluated").isEmpty():
        raise ValueError("missing values in quasi-identifiers or sensitive attributes")
    return records


def cap_summary(records: DataFrame) -> DataFrame:
    """One row per evaluation."""
    n = F.count_if("evaluated")
    count = lambda c: F.count_if(c)
    matched = F.col("evaluated") & (F.col("key_matches") > 0)
    return records.groupBy("evaluation").agg(
        F.count("*").alias("n_original"),
        n.alias("n_evaluated"),
        F.avg("cap").alias("mean_cap"),
        F.max("cap").alias("max_cap"),
        count(matched).alias("n_matched"),
        F.try_divide(count(matched), n).alias("matched_ratio"),
        count(F.col("evaluated") & (F.col("key_matches") == 0)).alias("n_unmatched"),
        F.avg(F.when(matched, F.col("cap"))).alias("mean_cap_matched"),
        count(F.coalesce("exceeds", F.lit(False))).alias("exceed_count"),
        F.try_divide(count(F.coalesce("exceeds", F.lit(False))), n).alias("exceed_ratio"),
        count(F.col("reason") == "missing_key").alias("n_missing_key"),
        count(F.col("reason") == "missing_target").alias("n_missing_target"),
        count(F.col("reason") == "missing_key_and_target").alias("n_missing_both"),
        F.try_divide(count(~F.col("evaluated")), F.count("*")).alias("excluded_ratio"),
    )


def valid_synthetic(synthetic: DataFrame, options: CapOptions) -> DataFrame:
    """evaluation, synthetic_valid_count: synthetic records without a missing value among keys and targets."""
    k = list(options.quasi_identifiers)
    s = synthetic.select(*as_texts(synthetic, [*k, *options.sensitive]))
    known = lambda t: reduce(lambda a, b: a & b, (q(c).isNotNull() for c in (*k, *t)))
    wide = s.agg(*(F.count_if(known(t)).alias(f"e{i}") for i, (_, t) in enumerate(options.evaluations())))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(name).alias("evaluation"), F.col(f"e{i}").alias("synthetic_valid_count")) for i, (name, _) in enumerate(options.evaluations())))))


def named_records(records: DataFrame, options: CapOptions) -> DataFrame:
    """``cap_records`` under the names of the record file."""
    of = {name: t for name, t in options.evaluations()}
    pick = lambda value: F.coalesce(*(F.when(F.col("evaluation") == name, F.lit(value(t))) for name, t in of.items()))
    return records.select(
        "original_row",
        pick(" + ".join).alias("sensitive_column"),
        F.col("key_matches").alias("key_match_count"),
        F.col("target_matches").alias("target_match_count"),
        "cap",
        F.when(F.col("evaluated"), F.col("key_matches") > 0).alias("matched"),
        F.col("exceeds").alias("exceeds_threshold"),
        "evaluated",
        F.col("reason").alias("exclusion_reason"),
        pick(lambda t: "individual" if len(t) == 1 else "combined").alias("evaluation_type"),
        pick(lambda t: json.dumps(t, ensure_ascii=False)).alias("sensitive_columns"),
    )


def linkage_value(summary: DataFrame) -> DataFrame:
    """One row: value (largest mean cap), exceed_count, exceed_ratio over all evaluated records, passed."""
    total = F.sum("exceed_count")
    return summary.agg(F.max("mean_cap").alias("value"), total.alias("exceed_count"), F.try_divide(total, F.sum("n_evaluated")).alias("exceed_ratio"), F.sum("n_evaluated").alias("n_evaluated_records"), (total == 0).alias("passed"))
