import math

import numpy as np
import pytest

from twinlens.functions.distance import block_keys, pair_key, prepare
from twinlens.functions.schema import AnalysisSchema, DataValidationError, coerce, contiguous_ids, infer_schema
from twinlens.operators import association, inference, linkage, neighbours, propensity, reduction, single_out, thresholds, univariate, validation


def mixed(spark, n, seed, nulls=False):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        income = float(r.choice([100.0, 150.0, 200.0, 250.0]))
        rows.append((k, int(r.integers(20, 25)), None if nulls and r.random() < 0.2 else income, str(r.choice(["M", "F"])), str(r.choice(list("abcd")))))
    return spark.createDataFrame(rows, "row_id long, age long, `소득/월` double, sex string, `등급.x` string")


SCHEMA = AnalysisSchema(("age", "소득/월", "sex", "등급.x"), ("sex", "등급.x"), ("age", "소득/월"))


def naive(f, q, t, skip_self=False):
    out = {}
    for a in q:
        best = None
        for b in t:
            if skip_self and a["row_id"] == b["row_id"]:
                continue
            total = over = 0.0
            for k in range(f.n_numeric):
                if a[f"n{k}"] is not None and b[f"n{k}"] is not None:
                    total, over = total + abs(a[f"n{k}"] - b[f"n{k}"]), over + 1
            dot = sum((a[f"n{k}"] or 0) * (b[f"n{k}"] or 0) for k in range(f.n_numeric))
            miss = sum(a[f"c{k}"] != b[f"c{k}"] for k in range(f.n_categorical))
            p = f.n_numeric + f.n_categorical
            d = (total + miss) / (over + f.n_categorical) if f.metric == "gower" else 1 - (2 * (f.n_categorical - miss) - f.n_categorical + f.n_numeric * dot) / p
            key = (round(d, 10), b["row_id"])
            best = key if best is None or key < best else best
        out[a["row_id"]] = best
    return out


@pytest.mark.parametrize("metric", ["gower", "cosine"])
@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_equals_a_double_loop(spark, metric, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    nulls = metric == "gower"
    o, s = mixed(spark, 40, 1, nulls), mixed(spark, 30, 2, nulls)
    f = prepare(o, SCHEMA, metric)
    fo, fs = f.of(o, "row_id"), f.of(s, "row_id")
    a, b = fo.collect(), fs.collect()
    got = {r.row_id: (round(r.dkey / 1e12, 10), r.neighbour) for r in neighbours.nearest(fs, fo, f).collect()}
    assert got == naive(f, b, a)
    got = {r.row_id: (round(r.dkey / 1e12, 10), r.neighbour) for r in neighbours.nearest(fo, fo, f, not_itself=True).collect()}
    assert got == naive(f, a, a, True)
    pairs = fs.alias("a").join(fo.alias("b"), how="cross").select("a.row_id", pair_key(f).alias("k")).groupBy("row_id").agg({"k": "min"}).collect()
    assert {r[0]: round(r[1] / 1e12, 10) for r in pairs} == {k: v[0] for k, v in naive(f, b, a).items()}


def test_k_nearest_lists(spark):
    o = mixed(spark, 50, 3)
    f = prepare(o, SCHEMA)
    fo = f.of(o, "row_id")
    rows = fo.collect()
    qn = np.array([[r.n0, r.n1] for r in rows])
    qc = np.array([[hash(r.c0) % 1000003, hash(r.c1) % 1000003] for r in rows])
    key = block_keys(f, qn, qc, qn, qc)
    ids = np.array([r.row_id for r in rows])
    got = {}
    for r in neighbours.k_nearest(fo, fo, f, 6, not_itself=True).collect():
        got.setdefault(r.row_id, {})[r.pos] = r.neighbour
    for i in range(50):
        order = [ids[j] for j in np.lexsort((ids, key[i])) if j != i][:6]
        assert [got[ids[i]][p] for p in range(6)] == order


def test_distance_errors(spark):
    o = mixed(spark, 10, 1, True)
    with pytest.raises(ValueError):
        prepare(o, SCHEMA, "euclid")
    with pytest.raises(ValueError):
        prepare(o, SCHEMA, "cosine")
    with pytest.raises(ValueError):
        prepare(o, AnalysisSchema((), (), ()))


def test_single_out_golden(spark):
    o = spark.createDataFrame([("a", "1")] * 3 + [("b", "2"), ("c", "3")], "x string, y string")
    s = spark.createDataFrame([("a", "1"), ("b", "2"), ("z", "9"), ("c", "3")], "x string, y string")
    assert abs(single_out.single_out_risk(o, s, ["x", "y"]).first().value - (1 / 3 + 1 + 0 + 1) / 4) < 1e-12
    assert single_out.single_out_risk(o, s, ["x", "y"], False).first().value == 0.75
    n = spark.createDataFrame([("a", 1.0), (None, None)], "x string, y double")
    assert single_out.single_out_risk(n, n.where("x is null"), ["x", "y"]).first().value == 1.0
    assert single_out.without_exact_matches(n, n, ["x", "y"]).count() == 0
    loo = single_out.leave_one_out(spark.createDataFrame([(c,) for c in "aaabbc"], "x string"), ["x"]).first()
    assert abs(loo.p_equation_2 - (3 * 0.5 + 2 * 1) / 6) < 1e-12 and abs(loo.p_equation_1 - 5 / 6) < 1e-12


def test_cap_golden(spark):
    o = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "null", "x"), (3, "a", "")], "row_id long, k string, t string")
    s = spark.createDataFrame([("a", "x"), ("a", "z"), ("NaN", "x")], "k string, t string")
    rows = {r.original_row: r for r in linkage.cap_records(o, s, linkage.CapOptions(("k",), ("t",), 0.4), "row_id").collect()}
    assert [rows[k].cap for k in range(4)] == [0.5, 0.0, None, None]
    assert [rows[k].reason for k in range(4)] == ["", "", "missing_key", "missing_target"]
    records = linkage.cap_records(o, s, linkage.CapOptions(("k",), ("t",), 0.4), "row_id")
    summary = linkage.cap_summary(records).first()
    assert (summary.mean_cap, summary.n_unmatched, summary.exceed_count) == (0.25, 1, 1)
    assert linkage.linkage_value(linkage.cap_summary(records)).first().passed is False
    for bad in (linkage.CapOptions((), ("t",)), linkage.CapOptions(("k",), ("k",)), linkage.CapOptions(("k",), ("t",), 2), linkage.CapOptions(("k",), ("q",)), linkage.CapOptions(("k",), ("t",), 0.5, "drop")):
        with pytest.raises(ValueError):
            linkage.cap_records(o, s, bad, "row_id")
    with pytest.raises(ValueError):
        linkage.cap_records(o, s, linkage.CapOptions(("k",), ("t",), 0.4, "error"), "row_id")


def test_schema_and_coercion(spark):
    df = spark.createDataFrame([(1, 1.0, True, "x", 1.5), (2, float("nan"), False, None, 2.0)], "a int, b double, c boolean, d string, e double")
    schema = infer_schema(df, ["b", "e"])
    assert schema.numeric == ("a",)
    rows = coerce(df, schema).collect()
    assert [tuple(r) for r in rows] == [(1.0, "1", "True", "x", "1.5"), (2.0, None, "False", None, "2.0")]
    with pytest.raises(DataValidationError):
        infer_schema(df, ["zz"])
    text = spark.createDataFrame([("1",), ("x",)], "a string")
    with pytest.raises(DataValidationError, match="x"):
        coerce(text, AnalysisSchema(("a",), (), ("a",)))


def test_contiguous_ids(spark):
    df = spark.createDataFrame([(k * 7 % 1009,) for k in range(1000)], "key long")
    rows = contiguous_ids(df, "key").collect()
    keys = sorted(r.key for r in rows)
    assert {r.key: r.row_id for r in rows} == {k: i for i, k in enumerate(keys)}


def test_validation(spark):
    o, s = mixed(spark, 30, 1).drop("row_id"), mixed(spark, 25, 2, True).drop("row_id")
    pair = validation.validate_pair(o, s.select("sex", "age", "`소득/월`", "`등급.x`"))
    assert pair.report["column_order_reordered"] and pair.report["passed"]
    assert [m["column"] for m in pair.report["format"]["missing"]] == ["소득/월"]
    with pytest.raises(DataValidationError):
        validation.validate_pair(o, s.withColumnRenamed("sex", "gender"))
    with pytest.raises(DataValidationError):
        validation.validate_pair(o, s.withColumn("age", s.age.cast("string")))
    warned = validation.validate_pair(o, s.withColumn("age", s.age.cast("double")), with_format=False)
    assert warned.report["type_warnings"][0]["warning"] == "numeric_dtype_differs"


def test_associations_against_numpy(spark):
    o = mixed(spark, 200, 5)
    rows = o.toPandas()
    got = {(r.column_1, r.column_2): r.value for r in association.associations(o, SCHEMA).collect()}
    assert abs(got["age", "소득/월"] - np.corrcoef(rows["age"], rows["소득/월"])[0, 1]) < 1e-9
    y = rows["age"].to_numpy(float)
    means = rows.groupby("sex")["age"].transform("mean").to_numpy()
    assert abs(got["sex", "age"] - ((means - y.mean()) ** 2).sum() / ((y - y.mean()) ** 2).sum()) < 1e-9
    table = np.array([[((rows["sex"] == a) & (rows["등급.x"] == b)).sum() for b in "abcd"] for a in "MF"], float)
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert abs(got["sex", "등급.x"] - math.sqrt(((table - e) ** 2 / e).sum() / table.sum())) < 1e-9
    value, pairs, constant = association.bivariate_similarity(o, o, SCHEMA)
    assert value.first().value == 0 and constant == [] and pairs.count() == 6


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 1.0), (1, None, None, 2.0)], "a int, b string, c string, d double")
    assert association.constant_columns(df, ["a", "b", "c", "d"]) == ["a", "b"]


def test_univariate(spark):
    o, s = mixed(spark, 100, 6), mixed(spark, 80, 7)
    out = univariate.univariate_similarity(o, s, SCHEMA)
    x, y = np.array([r.age for r in o.collect()]), np.array([r.age for r in s.collect()])
    want = max(abs((x <= v).mean() - (y <= v).mean()) for v in range(20, 25))
    assert abs(out["details"]["variables"]["age"]["statistic"] - want) < 1e-9
    assert out["value"] is None and out["details"]["n_variables"] == 4
    assert univariate.univariate_similarity(o, o, SCHEMA)["details"]["n_significant"] == 0


def test_inference_flags(spark):
    o, s = mixed(spark, 50, 8), mixed(spark, 35, 9)
    f = prepare(o, SCHEMA)
    fo, fs = f.of(o, "row_id"), f.of(s, "row_id")
    a, b = fo.collect(), fs.collect()
    near, back = naive(f, b, a), naive(f, a, a, True)
    got = {r.row_id: (r.nearest_index, r.flag, r.tie) for r in inference.inference_records(fo, fs, f).collect()}
    assert got == {k: (v[1], v[0] < back[v[1]][0], v[0] == back[v[1]][0]) for k, v in near.items()}


@pytest.mark.parametrize("size", [64, 2])
def test_simulated_inference(spark, size):
    n, seeds = 40, [5, 6, 7]
    o = mixed(spark, n, 10)
    f = prepare(o, SCHEMA)
    fo = f.of(o, "row_id").cache()
    rows = {r.row_id: r for r in fo.collect()}
    got = {r.sim: r.value for r in thresholds.simulate_inference(fo, f, n, seeds, size).collect()}
    for k, seed in enumerate(seeds):
        in_a = thresholds.split_in_a(n, seed)
        a, b = ([rows[i] for i in range(n) if in_a[i] == side] for side in (True, False))
        near, back = naive(f, b, a), naive(f, a, a, True)
        flags = [(v[0] < back[v[1]][0], v[0] == back[v[1]][0]) for v in near.values()]
        kept = [x for x, tie in flags if not tie]
        assert (got[k] is None and not kept) or abs(got[k] - np.mean(kept)) < 1e-9


def test_simulated_single_out_and_bivariate(spark):
    n, seeds = 60, [1, 2]
    o = mixed(spark, n, 11).cache()
    rows = {r.row_id: tuple(r)[1:] for r in o.collect()}
    got = {r.sim: r.value for r in thresholds.simulate_single_out(o, SCHEMA.columns, n, seeds).collect()}
    for k, seed in enumerate(seeds):
        in_a = thresholds.split_in_a(n, seed)
        a = [rows[i] for i in range(n) if in_a[i]]
        b = [rows[i] for i in range(n) if not in_a[i]]
        assert abs(got[k] - np.mean([1 / a.count(x) if x in a else 0 for x in b])) < 1e-9
    values, constant = thresholds.simulate_bivariate(o, SCHEMA, n, seeds)
    assert constant == [] and all(0 <= r.value < 1 for r in values.collect())


def test_pmse_and_strategies(spark):
    o, s = mixed(spark, 60, 12), mixed(spark, 90, 13)
    scores = propensity.propensity_scores(o, s, SCHEMA, row="row_id")
    row = propensity.pmse(scores).first()
    assert 0 <= row.value <= 0.26 and abs(row.synthetic_share - 0.6) < 1e-12
    again = propensity.pmse(propensity.propensity_scores(o, s, SCHEMA, row="row_id")).first()
    assert abs(row.value - again.value) < 1e-9
    with pytest.raises(ValueError):
        propensity.propensity_scores(o, s, SCHEMA, "forest")
    with pytest.raises(ValueError, match="Invalid --model_params"):
        propensity.propensity_scores(o, s, SCHEMA, params={"zz": 1})
    with pytest.raises(ValueError):
        propensity.propensity_scores(o, mixed(spark, 20, 1, True), SCHEMA)
    tree = propensity.propensity_scores(o, mixed(spark, 20, 1, True), SCHEMA, "decision_tree", {"max_depth": 3})
    assert propensity.pmse(tree).first().value >= 0
    for name, options in (("random", {}), ("pmse_probability", {}), ("inference_distance", {"threshold": 0.45})):
        deleted, details = reduction.reduce_rows(name, reduction.Context(o, s, SCHEMA, 60, 90, 1, options))
        assert deleted.distinct().count() == 30 == details["n_deleted"]
    with pytest.raises(ValueError):
        reduction.reduce_rows("inference_distance", reduction.Context(o, s, SCHEMA, 60, 90))
    with pytest.raises(ValueError):
        reduction.reduce_rows("zz", reduction.Context(o, s, SCHEMA, 60, 90))
