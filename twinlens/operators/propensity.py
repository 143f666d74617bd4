"""Propensity-score mean squared error: how well a model tells synthetic from original rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import AnalysisSchema, q

MODELS = ("logistic_regression", "decision_tree", "gradient_boosting")
#: Parameter names users know, and Spark's.
PARAMETERS = {
    "logistic_regression": {"C": "C", "max_iter": "maxIter", "tol": "tol"},
    "decision_tree": {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode"},
    "gradient_boosting": {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "min_samples_leaf": "minInstancesPerNode", "subsample": "subsamplingRate"},
}


@dataclass
class Scores:
    """scored: row_id, label (1 synthetic), p (probability of synthetic), prediction."""

    scored: DataFrame
    n_original: int
    n_synthetic: int


def _classifier(model: str, params: dict, seed: int, n: int):
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {MODELS}")
    known = PARAMETERS[model]
    if unknown := sorted(set(params) - set(known)):
        raise ValueError(f"Invalid --model_params: {unknown}")
    own = {known[k]: v for k, v in params.items() if v is not None}
    common = {"featuresCol": "features", "labelCol": "label"}
    if model == "logistic_regression":
        c = own.pop("C", 1.0)
        return LogisticRegression(**common, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, family="binomial", **({"maxIter": 1000, "tol": 1e-9} | own))
    if model == "decision_tree":
        return DecisionTreeClassifier(**common, seed=seed, maxBins=256, **({"maxDepth": 30} | own))
    return GBTClassifier(**common, seed=seed, maxBins=256, **({"maxIter": 100, "maxDepth": 3, "stepSize": 0.1} | own))


def propensity_scores(original: DataFrame, synthetic: DataFrame, schema: AnalysisSchema, model: str = "logistic_regression", params: dict | None = None, seed: int = 42, row: str | None = None) -> Scores:
    """Fits and scores in sample.  Missing categories are all-zero dummies; missing numbers are for trees only."""
    names = {c: f"f{k}" for k, c in enumerate(schema.columns)}
    side = lambda df, label: df.select((q(row) if row else F.lit(0)).cast("long").alias("row_id"), *(q(c).alias(names[c]) for c in schema.columns), F.lit(float(label)).alias("label"))
    pooled = side(original, 0).unionByName(side(synthetic, 1))
    sizes = pooled.groupBy("label").agg(F.count("*").alias("n"), *(F.count_if(F.col(names[c]).isNull()).alias(f"m{names[c]}") for c in schema.numeric)).collect()
    n = {int(r["label"]): r["n"] for r in sizes}
    numeric = [names[c] for c in schema.numeric]
    missing = [c for c in numeric if any(r[f"m{c}"] for r in sizes)]
    if missing and model != "decision_tree":
        raise ValueError(f"missing numbers, which {model} doesn't take: {[c for c in schema.numeric if names[c] in missing]}")
    for c in missing:  # trees of this library take no NaN: a value below all others, and an indicator
        low = pooled.agg(F.min(c)).first()[0] or 0.0
        pooled = pooled.withColumn(f"{c}_missing", F.col(c).isNull().cast("double")).withColumn(c, F.coalesce(c, F.lit(low - 1.0)))
        numeric.append(f"{c}_missing")
    levels = [names[c] for c in schema.categorical]
    stages = []
    if levels:
        known = {c: F.coalesce(c, F.lit("\0missing")) for c in levels}
        pooled = pooled.withColumns(known)
        stages = [StringIndexer(inputCols=levels, outputCols=[f"{c}_i" for c in levels], stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{c}_i" for c in levels], outputCols=[f"{c}_v" for c in levels], dropLast=False)]
    stages.append(VectorAssembler(inputCols=[*numeric, *(f"{c}_v" for c in levels)], outputCol="features"))
    pooled = pooled.cache()
    try:
        fitted = Pipeline(stages=[*stages, _classifier(model, params or {}, seed, sum(n.values()))]).fit(pooled)
        scored = fitted.transform(pooled).select("row_id", "label", F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "prediction")
    finally:
        pooled.unpersist()
    return Scores(scored, n.get(0, 0), n.get(1, 0))


def pmse(scores: Scores) -> DataFrame:
    """One row: value (mean over both probability columns of the squared distance from the synthetic share), accuracy, synthetic_share."""
    c = scores.n_synthetic / (scores.n_original + scores.n_synthetic)
    p = F.col("p")
    square = (F.avg((p - c) * (p - c)) + F.avg((1 - p - c) * (1 - p - c))) / 2
    return scores.scored.agg(square.alias("value"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.lit(c).alias("synthetic_share"))
