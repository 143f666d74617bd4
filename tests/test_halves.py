"""Halves of many simulations kept as bits of a row."""

import hashlib
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlens.functions.schema import AnalysisSchema
from twinlens.operators import association, halves, thresholds

PAIRED = AnalysisSchema(("a", "b", "c", "x", "y"), ("a", "b", "c"), ("x", "y"))


def paired(spark, n, seed):
    """Rows of two-level, many-level and missing categories, and numbers far from 0."""
    r = np.random.default_rng(seed)
    level = lambda k: [None if r.random() < 0.1 else f"l{v}" for v in r.integers(0, k, n)]
    x = [None if r.random() < 0.1 else 1e6 + float(v) for v in r.normal(size=n)]
    return spark.createDataFrame(list(zip(range(n), level(2), level(2), level(7), x, map(float, r.normal(size=n)))), "row_id long, a string, b string, c string, x double, y double")


def in_a_of(table, n, seeds):
    if n is not None:
        return [halves.split_in_a(n, s) for s in seeds]
    ids = [r.row_id for r in table.select("row_id").orderBy("row_id").collect()]
    return [np.array([hashlib.md5(f"{s}:{i}".encode()).hexdigest() < "8" for i in ids]) for s in seeds]


def never_broadcast(df):
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_hash_over_arrays():
    names = ["", "0", "-17", "é", "x" * 44, "x" * 60, *map(str, range(5000))]
    seeds = [3, 2**31 - 2, *thresholds.derive_seeds(1, 5)]
    got = halves.hashed_in_a(pa.array(names), seeds)
    assert all(got[i, k] == (hashlib.md5(f"{s}:{x}".encode()).hexdigest() < "8") for (i, x), (k, s) in product(enumerate(names), enumerate(seeds)))


@pytest.mark.parametrize("n", [9000, None])
def test_one_row_keeps_all_its_halves(spark, n):
    seeds = [1, 2, 3, 4, 5, 6, 7, 8, 9]
    table = spark.range(9000).withColumnRenamed("id", "row_id").withColumn("more", F.lit("m"))
    rows = sorted(halves.with_halves(table, n, seeds).collect())
    assert len(rows) == 9000 and rows[0].more == "m"
    bits = np.unpackbits(np.array([list(r.halves) for r in rows], np.uint8), axis=1, bitorder="little", count=9)
    assert (bits.T == np.array(in_a_of(table, n, seeds))).all()


def expected_bivariate(table, n, seeds):
    out = {}
    for k, in_a in enumerate(in_a_of(table, n, seeds)):
        a = [i for i, side in enumerate(in_a) if side]
        pairs, _, _ = (lambda o, s: association.bivariate_similarity(o, s, PAIRED, False))(table.where(F.col("row_id").isin(a)), table.where(~F.col("row_id").isin(a)))
        out[k] = pairs.first()["value"]
    return out


def test_bivariate_of_permutations(spark):
    table = paired(spark, 150, 3).cache()
    values, _ = thresholds.simulate_bivariate(table, PAIRED, 150, [5, 6])
    assert {r.sim: r.value for r in values.collect()} == pytest.approx(expected_bivariate(table, 150, [5, 6]), abs=1e-9)
    never_broadcast(values)


def test_bivariate_without_a_value(spark):
    """A category with one level in a half has no association there."""
    table = spark.createDataFrame([(i, "x" if i else "z", "uv"[i % 2], float(i)) for i in range(12)], "row_id long, a string, b string, x double")
    values, _ = thresholds.simulate_bivariate(table, AnalysisSchema(("a", "b", "x"), ("a", "b"), ("x",)), 12, [1, 2])
    assert [r.value for r in values.collect()] == [None, None]


def test_bivariate_of_hashed_halves(spark):
    """Row ids with gaps, each counted once."""
    table = paired(spark, 150, 4).withColumn("row_id", F.col("row_id") * 3 + 7).cache()
    dealt = dict(zip([r.row_id for r in table.select("row_id").orderBy("row_id").collect()], zip(*in_a_of(table, None, [5, 6]))))
    want = {}
    for k in (0, 1):
        a = [i for i, sides in dealt.items() if sides[k]]
        want[k] = association.bivariate_similarity(table.where(F.col("row_id").isin(a)), table.where(~F.col("row_id").isin(a)), PAIRED, False)[0].first()["value"]
    values, _ = thresholds.simulate_bivariate(table, PAIRED, None, [5, 6])
    assert {r.sim: r.value for r in values.collect()} == pytest.approx(want, abs=1e-9)
    never_broadcast(values)


@pytest.mark.parametrize(("n", "k"), [(60, 64), (60, 2), (None, 64), (None, 2)])
def test_inference_with_equal_rows(spark, n, k):
    """Lists are those of distinct records; a row is no neighbour of itself, an equal row is."""
    from twinlens.functions.distance import prepare

    seeds, schema = [1, 2, 3], AnalysisSchema(("c", "x"), ("c",), ("x",))
    r = np.random.default_rng(2)
    table = spark.createDataFrame([(i, "uvw"[c], float(x)) for i, (c, x) in enumerate(zip(r.integers(0, 3, 60), r.integers(0, 6, 60)))], "row_id long, c string, x double").cache()
    f = prepare(table, schema)
    rows = sorted(table.collect())
    span = max(x.x for x in rows) - min(x.x for x in rows)
    far = lambda a, b: round(((a.c != b.c) + abs(a.x - b.x) / span) / 2, 9)
    nearest = lambda a, side: min((far(a, b), b.row_id) for b in side if b.row_id != a.row_id)
    values = thresholds.simulate_inference(f.of(table, "row_id"), f, n, seeds, k)
    got = {v.sim: (v.value, v.n_ties) for v in values.collect()}
    for s, in_a in enumerate(in_a_of(table, n, seeds)):
        a = [x for x, side in zip(rows, in_a) if side]
        met = [(d, nearest(rows[m], a)[0]) for d, m in (nearest(x, a) for x, side in zip(rows, in_a) if not side)]
        ties = sum(d == e for d, e in met)
        assert got[s] == (pytest.approx(sum(d < e for d, e in met) / (len(met) - ties)) if ties < len(met) else None, ties)
    if k == 64:  # else searches of single rows follow
        never_broadcast(values)


def never_broadcast_records(df):
    """Joins that are broadcast have one row a bucket on a side."""
    df.collect()
    keys = re.findall(r"Broadcast\w*Join \[(\w+)|(BroadcastNestedLoopJoin)", df._jdf.queryExecution().executedPlan().toString())
    assert not {k or other for k, other in keys} - {"b"}


@pytest.mark.parametrize("k", [1, 2])
def test_open_searches_broadcast_no_records(spark, k):
    """Short lists leave searches open in every simulation; their rows are no broadcast side, whatever their estimated size."""
    from twinlens.functions.distance import prepare

    table = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 5).cast("string").alias("c"), (F.col("id") * 7919 % 3001).cast("double").alias("x"))
    schema = AnalysisSchema(("c", "x"), ("c",), ("x",))
    f = prepare(table, schema)
    values = thresholds.simulate_inference(f.of(table, "row_id"), f, None, [1, 2], k)
    never_broadcast_records(values)
    assert all(v.n_fallbacks > 0 for v in values.collect())


def test_lists_broadcast_no_records(spark):
    from twinlens.functions.distance import prepare
    from twinlens.operators.neighbours import record_lists

    table = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 5).cast("string").alias("c"), (F.col("id") * 7919 % 3001).cast("double").alias("x"))
    f = prepare(table, AnalysisSchema(("c", "x"), ("c",), ("x",)))
    lists = record_lists(f.of(table, "row_id"), f, 3)[1]
    never_broadcast_records(lists)
    assert lists.count() == 9000


@pytest.mark.parametrize("n", [5000, None])
def test_single_out_keeps_rows_by_record(spark, n):
    """One record with thousands of copies, others with few or none; a task takes each record's counts, not rows times simulations."""
    table = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 3000, "common").when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise((F.col("id") % 700).cast("string")).alias("c"))
    seeds = [1, 2, 3]
    values = thresholds.simulate_single_out(table, ["c"], n, seeds)
    got = {v.sim: v.value for v in values.collect()}
    rows = sorted(table.collect())
    for s, in_a in enumerate(in_a_of(table, n, seeds)):
        a, b = ([x.c for x, side in zip(rows, in_a) if side == which] for which in (True, False))
        copies = {c: a.count(c) for c in set(a)}
        assert got[s] == pytest.approx(sum(1 / copies[c] for c in b if c in copies) / len(b), abs=1e-9)
    never_broadcast(values)
    assert thresholds.simulate_single_out(table.limit(0), ["c"], None, seeds).count() == 0


def test_pmse_of_all_simulations_at_once(spark):
    """The values of one fit after the other, and where those have no penalty gradient left."""
    from twinlens.operators import propensity

    r = np.random.default_rng(8)
    level = lambda k: [None if v == 0 else f"l{v}" for v in r.integers(0, k, 200)]
    table = spark.createDataFrame(list(zip(range(200), level(3), level(5), map(float, r.normal(50, 9, 200)), map(float, r.normal(size=200)))), "row_id long, a string, b string, x double, `y.z` double").cache()
    schema, seeds = AnalysisSchema(("a", "b", "x", "y.z"), ("a", "b"), ("x", "y.z")), [3, 4]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pmse", "pmse")
    got = dict(thresholds.simulate_pmse(table, schema, 200, seeds))
    assert all(type(v) is float for v in got.values())
    assert len(jobs.getJobIdsForGroup("pmse")) < 60  # passes, not fits
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for s, seed in enumerate(seeds):
        in_a = [i for i, side in enumerate(halves.split_in_a(200, seed)) if side]
        scores = propensity.propensity_scores(table.where(F.col("row_id").isin(in_a)), table.where(~F.col("row_id").isin(in_a)), schema, params={"tol": 1e-13}, row="row_id")
        assert got[s] == pytest.approx(propensity.pmse(scores).first()["value"], abs=1e-7)
    with pytest.raises(ValueError, match="Invalid --model_params"):
        thresholds.simulate_pmse(table, schema, 200, seeds, params={"zz": 1})
    with pytest.raises(ValueError, match="missing numbers"):
        thresholds.simulate_pmse(table.withColumn("x", F.when(F.col("row_id") > 3, F.col("x"))), schema, 200, seeds)
