"""Registered queries of the evaluation operators, and their SQL.

Pair queries run over whole tables, dealt to both sides, all others over the whole table.
Doubles are rounded on both sides, so that a different order of summation doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import Features, pair_key, prepare
from ..functions.schema import contiguous_ids
from ..functions.stats import normal_threshold
from ..operators import association, inference, linkage, neighbours, propensity, reduction, single_out, thresholds, univariate, validation
from .pairs import CAP, CONSTANT, CUSTOMER, EVENTS, LINEITEM, ORDERS, ORDERS_FINE, PART, PART_OVERSIZED, PART_SHIFTED, SUPPLIER, PairPlan

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Rows of the simulations registered as queries.
SIMULATIONS, SEED, QUANTILE = 100, 42, 0.95


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.select(*(F.round(F.col(c), digits).alias(c) if c in doubles else F.col(c) for c in df.columns))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- exact matches -----------------------------------------------------------------

_ORDER_KEYS = "o_orderstatus, o_orderpriority, price_bucket"
_GROUPS = f"WITH {ORDERS.sql()}, g AS (SELECT {_ORDER_KEYS}, count(*) FILTER (side = 0) AS n_o, count(*) FILTER (side = 1) AS n_s FROM (SELECT {_ORDER_KEYS}, 0 AS side FROM o UNION ALL SELECT {_ORDER_KEYS}, 1 FROM s) GROUP BY ALL)"
_SINGLE_OUT = """ SELECT round(sum(CASE WHEN n_o > 0 THEN {hit} ELSE 0.0 END) / sum(n_s), 9) AS value,
  CAST(sum(CASE WHEN n_o > 0 THEN n_s ELSE 0 END) AS BIGINT) AS n_matched_records, round(sum(CASE WHEN n_o > 0 THEN n_s ELSE 0 END) / sum(n_s), 9) AS matched_ratio,
  CAST(sum(CASE WHEN n_o > 1 THEN n_o ELSE 0 END) AS BIGINT) AS n_original_duplicate_records, CAST(sum(n_s) AS BIGINT) AS n_synthetic FROM g"""


@query("single_out_eq1", _GROUPS + _SINGLE_OUT.format(hit="CAST(n_s AS DOUBLE)"))
def single_out_eq1(spark: SparkSession, d: str) -> DataFrame:
    o, s = ORDERS.load(spark, d)
    return rounded(single_out.single_out_risk(o, s, list(ORDERS.columns), by_duplicates=False))


@query("single_out_eq2", _GROUPS + _SINGLE_OUT.format(hit="CAST(n_s AS DOUBLE) / n_o"))
def single_out_eq2(spark: SparkSession, d: str) -> DataFrame:
    o, s = ORDERS.load(spark, d)
    return rounded(single_out.single_out_risk(o, s, list(ORDERS.columns)))


@query("record_groups", _GROUPS + f" SELECT {_ORDER_KEYS}, n_o, n_s FROM g")
def record_groups(spark: SparkSession, d: str) -> DataFrame:
    o, s = ORDERS.load(spark, d)
    return single_out.record_groups(o, s, list(ORDERS.columns))


@query("single_out_leave_one_out", f"""WITH {ORDERS.whole_sql()}, n AS (SELECT count(*) AS n FROM o GROUP BY {_ORDER_KEYS})
SELECT round(sum(CASE WHEN n > 1 THEN CAST(n AS DOUBLE) ELSE 0 END) / sum(n), 9) AS p_equation_1,
       round(sum(CASE WHEN n > 1 THEN CAST(n AS DOUBLE) / (n - 1) ELSE 0 END) / sum(n), 9) AS p_equation_2, CAST(sum(n) AS BIGINT) AS n FROM n""")
def single_out_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return rounded(single_out.leave_one_out(ORDERS.whole(spark, d), list(ORDERS.columns)))


@query("exact_match_removal", f"WITH {ORDERS.sql()} SELECT row_id, {_ORDER_KEYS} FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_orderstatus IS NOT DISTINCT FROM s.o_orderstatus AND o.o_orderpriority IS NOT DISTINCT FROM s.o_orderpriority AND o.price_bucket IS NOT DISTINCT FROM s.price_bucket)")
def exact_match_removal(spark: SparkSession, d: str) -> DataFrame:
    o, s = ORDERS.load(spark, d)
    return single_out.without_exact_matches(o, s, list(ORDERS.columns))


@query("normal_threshold", f"""WITH {ORDERS.whole_sql()}, n AS (SELECT count(*) AS n FROM o GROUP BY {_ORDER_KEYS}),
p AS (SELECT sum(CASE WHEN n > 1 THEN CAST(n AS DOUBLE) / (n - 1) ELSE 0 END) / sum(n) AS p, CAST(sum(n) AS BIGINT) AS n FROM n)
SELECT round(p, 9) AS mean, round(p * (1 - p) / n, 12) AS variance, n, round(n * p * (1 - p), 6) AS npq, round(p + 1.6448536269514722 * sqrt(p * (1 - p) / n), 9) AS threshold, n * p * (1 - p) >= 10 AS reliable FROM p""")
def normal_threshold_query(spark: SparkSession, d: str) -> DataFrame:
    row = single_out.leave_one_out(ORDERS.whole(spark, d), list(ORDERS.columns)).first()
    t = normal_threshold(row["p_equation_2"], row["n"], QUANTILE)
    made = spark.createDataFrame([(t["mean"], t["variance"], t["n"], t["npq"], t["threshold"], t["normal_approximation_reliable"])], "mean double, variance double, n bigint, npq double, threshold double, reliable boolean")
    return made.select(F.round("mean", 9).alias("mean"), F.round("variance", 12).alias("variance"), "n", F.round("npq", 6).alias("npq"), F.round("threshold", 9).alias("threshold"), "reliable")


# --- linkage -----------------------------------------------------------------------

_K = ("o_orderstatus", "o_orderpriority")
_CAP_ONE = """SELECT '{name}' AS evaluation, r.original_row, {ok} AS evaluated, {reason} AS reason,
  CASE WHEN {ok} THEN coalesce(k.n, 0) END AS key_matches, CASE WHEN {ok} THEN coalesce(t.n, 0) END AS target_matches,
  CASE WHEN {ok} THEN coalesce(CAST(t.n AS DOUBLE) / k.n, 0.0) END AS cap, CASE WHEN {ok} THEN coalesce(CAST(t.n AS DOUBLE) / k.n, 0.0) > {threshold} END AS exceeds
FROM r LEFT JOIN (SELECT {K}, count(*) AS n FROM cs WHERE {known} GROUP BY {K}) k ON {on_k}
       LEFT JOIN (SELECT {K}, {T}, count(*) AS n FROM cs WHERE {known} GROUP BY {K}, {T}) t ON {on_t}"""


def _cap_sql(plan: PairPlan, options: linkage.CapOptions) -> str:
    texts = ", ".join(f"CASE WHEN {c} NOT IN ('', 'None', 'null', 'NULL', 'NaN', 'nan') THEN {c} END AS {c}" for c in (*options.quasi_identifiers, *options.sensitive))
    parts = []
    for name, t in options.evaluations():
        k = options.quasi_identifiers
        no_k, no_t = (" OR ".join(f"r.{c} IS NULL" for c in x) for x in (k, t))
        parts.append(_CAP_ONE.format(
            name=name, ok=f"NOT ({no_k} OR {no_t})", reason=f"CASE WHEN ({no_k}) AND ({no_t}) THEN 'missing_key_and_target' WHEN {no_k} THEN 'missing_key' WHEN {no_t} THEN 'missing_target' ELSE '' END",
            K=", ".join(k), T=", ".join(t), known=" AND ".join(f"{c} IS NOT NULL" for c in (*k, *t)), on_k=" AND ".join(f"k.{c} = r.{c}" for c in k), on_t=" AND ".join(f"t.{c} = r.{c}" for c in (*k, *t)), threshold=options.threshold))
    return f"WITH {plan.sql()}, r AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS original_row, {texts} FROM o), cs AS (SELECT {texts} FROM s), rec AS ({' UNION ALL '.join(parts)})"


_INDIVIDUAL = linkage.CapOptions(_K, ("order_year", "price_band"), 0.25)
_COMBINED = linkage.CapOptions(_K, ("order_year", "price_band"), 0.25, mode="combined")
_EVENT_CAP = linkage.CapOptions(("event_type",), ("user_band",), 0.1)
_SUMMARY_SQL = """ SELECT evaluation, count(*) AS n_original, count(*) FILTER (evaluated) AS n_evaluated, round(avg(cap), 9) AS mean_cap, round(max(cap), 9) AS max_cap,
  count(*) FILTER (evaluated AND key_matches > 0) AS n_matched, round(count(*) FILTER (evaluated AND key_matches > 0) / count(*) FILTER (evaluated), 9) AS matched_ratio,
  count(*) FILTER (evaluated AND key_matches = 0) AS n_unmatched, round(avg(cap) FILTER (key_matches > 0), 9) AS mean_cap_matched,
  count(*) FILTER (exceeds) AS exceed_count, round(count(*) FILTER (exceeds) / count(*) FILTER (evaluated), 9) AS exceed_ratio,
  count(*) FILTER (reason = 'missing_key') AS n_missing_key, count(*) FILTER (reason = 'missing_target') AS n_missing_target, count(*) FILTER (reason = 'missing_key_and_target') AS n_missing_both,
  round(count(*) FILTER (NOT evaluated) / count(*), 9) AS excluded_ratio FROM rec GROUP BY evaluation"""


def _cap(spark: SparkSession, d: str, plan: PairPlan, options: linkage.CapOptions, contiguous: bool = False) -> DataFrame:
    o, s = plan.load(spark, d)
    if contiguous:
        o = contiguous_ids(o, "row_id", "original_row").drop("row_id")
    return linkage.cap_records(o, s, options, "original_row" if contiguous else "row_id")


@query("cap_records", _cap_sql(CAP, _INDIVIDUAL) + " SELECT evaluation, original_row, evaluated, reason, key_matches, target_matches, round(cap, 9) AS cap, exceeds FROM rec")
def cap_records(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cap(spark, d, CAP, _INDIVIDUAL, contiguous=True))


@query("cap_summary_individual", _cap_sql(CAP, _INDIVIDUAL) + _SUMMARY_SQL)
def cap_summary_individual(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linkage.cap_summary(_cap(spark, d, CAP, _INDIVIDUAL)))


@query("cap_summary_combined", _cap_sql(CAP, _COMBINED) + _SUMMARY_SQL)
def cap_summary_combined(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linkage.cap_summary(_cap(spark, d, CAP, _COMBINED)))


@query("cap_missing_reasons", _cap_sql(EVENTS, _EVENT_CAP) + " SELECT evaluation, reason, count(*) AS n, round(avg(cap), 9) AS mean_cap FROM rec GROUP BY evaluation, reason")
def cap_missing_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cap(spark, d, EVENTS, _EVENT_CAP).groupBy("evaluation", "reason").agg(F.count("*").alias("n"), F.avg("cap").alias("mean_cap")))


@query("linkage_risk", _cap_sql(CAP, _COMBINED) + """, sm AS (SELECT avg(cap) AS m, count(*) FILTER (exceeds) AS x, count(*) FILTER (evaluated) AS n FROM rec GROUP BY evaluation)
SELECT round(max(m), 9) AS value, CAST(sum(x) AS BIGINT) AS exceed_count, round(sum(x) / sum(n), 9) AS exceed_ratio, CAST(sum(n) AS BIGINT) AS n_evaluated_records, sum(x) = 0 AS passed FROM sm""")
def linkage_risk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linkage.linkage_value(linkage.cap_summary(_cap(spark, d, CAP, _COMBINED))))


# --- validation --------------------------------------------------------------------

_EVENT_COLUMNS = tuple(EVENTS.columns)


@query("validation_missing_counts", f"WITH {EVENTS.sql()}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM o WHERE {c} IS NULL) AS n_o, (SELECT count(*) FROM s WHERE {c} IS NULL) AS n_s" for c in _EVENT_COLUMNS) + ') SELECT * FROM c WHERE n_o > 0 OR n_s > 0')
def validation_missing_counts(spark: SparkSession, d: str) -> DataFrame:
    return validation.missing_counts(*EVENTS.load(spark, d), _EVENT_COLUMNS)


@query("validation_missing_tokens", f"""WITH {EVENTS.sql()}, v AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, {k} AS side FROM {t}" for c in EVENTS.categorical for k, t in ((0, "o"), (1, "s"))) + """)
SELECT "column", value, count(*) FILTER (side = 0) AS n_o, count(*) FILTER (side = 1) AS n_s FROM v
WHERE value IN ('', ' ', 'NA', 'N/A', 'na', 'n/a', 'null', 'NULL', 'None', 'none', 'nan', 'NaN', '?', '-') OR trim(value) = '' GROUP BY "column", value""")
def validation_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return validation.missing_like(*EVENTS.load(spark, d), EVENTS.categorical)


def _levels_sql(a: str, b: str) -> str:
    return f"""WITH {ORDERS_FINE.sql()}, l AS (SELECT DISTINCT price_bucket AS v FROM {a} WHERE price_bucket IS NOT NULL EXCEPT SELECT price_bucket FROM {b})
SELECT 'price_bucket' AS "column", count(*) AS n_levels, array_to_string(list_slice(list(v ORDER BY v), 1, 10), ',') AS first_levels FROM l HAVING count(*) > 0"""


@query("validation_unseen", _levels_sql("s", "o"))
def validation_unseen(spark: SparkSession, d: str) -> DataFrame:
    return validation.unseen_levels(*ORDERS_FINE.load(spark, d), ["price_bucket"])


@query("validation_unused", _levels_sql("o", "s"))
def validation_unused(spark: SparkSession, d: str) -> DataFrame:
    return validation.unused_levels(*ORDERS_FINE.load(spark, d), ["price_bucket"])


@query("validation_out_of_range", f"WITH {PART_SHIFTED.sql()}, b AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT min({c}) FROM o) AS low, (SELECT max({c}) FROM o) AS high, (SELECT count(*) FROM s WHERE {c} < (SELECT min({c}) FROM o) OR {c} > (SELECT max({c}) FROM o)) AS n_outside" for c in PART.numeric) + ") SELECT * FROM b WHERE n_outside > 0")
def validation_out_of_range(spark: SparkSession, d: str) -> DataFrame:
    return validation.out_of_range(*PART_SHIFTED.load(spark, d), PART.numeric)


@query("constant_columns", f"WITH {CONSTANT.whole_sql()} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT) <= 1 FROM o) AS constant" for c in CONSTANT.columns) + ")")
def constant_columns(spark: SparkSession, d: str) -> DataFrame:
    found = association.constant_columns(CONSTANT.whole(spark, d), list(CONSTANT.columns))
    return spark.createDataFrame([(c, c in found) for c in CONSTANT.columns], "column string, constant boolean")


# --- univariate --------------------------------------------------------------------

_LONG_NUMERIC = f"WITH {LINEITEM.sql()}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x, {k} AS side FROM {t}" for c in LINEITEM.numeric for k, t in ((0, "o"), (1, "s"))) + ")"
_LONG_LEVELS = f"WITH {LINEITEM.sql()}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, {k} AS side FROM {t}" for c in LINEITEM.categorical for k, t in ((0, "o"), (1, "s"))) + """),
n AS (SELECT "column", value, count(*) FILTER (side = 0) AS n_o, count(*) FILTER (side = 1) AS n_s FROM v WHERE value IS NOT NULL GROUP BY "column", value)"""


@query("ks_statistic", _LONG_NUMERIC + """, c AS (SELECT "column", x, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM v WHERE x IS NOT NULL GROUP BY "column", x),
r AS (SELECT "column", sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY "column") AS m, sum(b) OVER (PARTITION BY "column") AS n FROM c WINDOW w AS (PARTITION BY "column" ORDER BY x))
SELECT "column", round(max(abs(ca / m - cb / n)), 9) AS statistic, CAST(max(m) AS BIGINT) AS n_o, CAST(max(n) AS BIGINT) AS n_s FROM r GROUP BY "column" """)
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(univariate.ks_statistics(*LINEITEM.load(spark, d), LINEITEM.numeric))


@query("chi2_statistic", _LONG_LEVELS + """, t AS (SELECT "column", sum(n_o) AS o, sum(n_s) AS s, count(*) AS k FROM n GROUP BY "column"),
e AS (SELECT "column", k, unnest([n_o, n_s]) AS obs, unnest([(n_o + n_s) * o / (o + s), (n_o + n_s) * s / (o + s)]) AS ex FROM n JOIN t USING ("column"))
SELECT "column", round(sum(CASE WHEN k = 1 THEN 0 WHEN k = 2 THEN pow(abs(obs - ex) - least(0.5, abs(obs - ex)), 2) / ex ELSE pow(obs - ex, 2) / ex END), 6) AS statistic, k - 1 AS dof, k AS n_categories FROM e GROUP BY "column", k""")
def chi2_statistic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(univariate.chi2_statistics(*LINEITEM.load(spark, d), LINEITEM.categorical), 6)


@query("category_bars", _LONG_LEVELS + """ SELECT "column", value, round(100 * n_o / sum(n_o) OVER (PARTITION BY "column"), 9) AS percent_o, round(100 * n_s / sum(n_s) OVER (PARTITION BY "column"), 9) AS percent_s FROM n""")
def category_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(univariate.category_bars(*LINEITEM.load(spark, d), LINEITEM.categorical))


@query("ecdf_grid", f"WITH {PART.sql()}, g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(i AS INT) AS point, CASE WHEN i = 49 THEN hi ELSE lo + (hi - lo) * i / 49 END AS x FROM range(50) t(i), (SELECT min({c}) AS lo, max({c}) AS hi FROM o)" for c in PART.numeric) + ") " + " UNION ALL ".join(f"SELECT \"column\", point, round(x, 9) AS x, round((SELECT count(*) FILTER ({c} <= g.x) / count({c}) FROM o), 9) AS ecdf_o, round((SELECT count(*) FILTER ({c} <= g.x) / count({c}) FROM s), 9) AS ecdf_s FROM g WHERE \"column\" = '{c}'" for c in PART.numeric))
def ecdf_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(univariate.ecdf_grid(*PART.load(spark, d), PART.numeric))


# --- bivariate ---------------------------------------------------------------------


def _pearson_sql(t: str, a: str, b: str) -> str:
    return f"SELECT '{a}' AS column_1, '{b}' AS column_2, 'pearson' AS method, (SELECT corr({a}, {b}) FROM {t}) AS value"


def _anova_sql(t: str, c: str, x: str) -> str:
    known = f"(SELECT {c} AS l, {x} AS y FROM {t} WHERE {c} IS NOT NULL AND {x} IS NOT NULL)"
    return f"""SELECT '{c}' AS column_1, '{x}' AS column_2, 'anova_r2' AS method, (SELECT sum(n * pow(m - g, 2)) / nullif(sum(n * pow(m - g, 2)) + sum(w), 0) FROM
  (SELECT count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w, (SELECT avg(y) FROM {known}) AS g FROM {known} GROUP BY l)) AS value"""


def _cramer_sql(t: str, a: str, b: str) -> str:
    k = f"(SELECT {a} AS a, {b} AS b FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    grid = f"""(SELECT x.a, y.b, coalesce(c.n, 0) AS n, CAST(x.n AS DOUBLE) * y.n / (SELECT count(*) FROM {k}) AS e, count(DISTINCT x.a) OVER () AS r, count(DISTINCT y.b) OVER () AS q
      FROM (SELECT a, count(*) AS n FROM {k} GROUP BY a) x CROSS JOIN (SELECT b, count(*) AS n FROM {k} GROUP BY b) y LEFT JOIN (SELECT a, b, count(*) AS n FROM {k} GROUP BY a, b) c ON c.a = x.a AND c.b = y.b)"""
    return f"""SELECT '{a}' AS column_1, '{b}' AS column_2, 'cramers_v' AS method, (SELECT sqrt(sum(CASE WHEN r = 2 AND q = 2 THEN pow(abs(n - e) - least(0.5, abs(n - e)), 2) / e ELSE pow(n - e, 2) / e END) / (SELECT count(*) FROM {k}) / nullif(least(any_value(r), any_value(q)) - 1, 0)) FROM {grid}) AS value"""


def _matrix_sql(t: str, plan: PairPlan) -> str:
    nn, cn, cc = association.column_pairs(plan.schema)
    return " UNION ALL ".join([*(_pearson_sql(t, *p) for p in nn), *(_anova_sql(t, *p) for p in cn), *(_cramer_sql(t, *p) for p in cc)])


def _value_only(part: list[str]) -> str:
    return f"WITH {LINEITEM.whole_sql()} SELECT column_1, column_2, method, round(value, 9) AS value FROM (" + " UNION ALL ".join(part) + ")"


_NN, _CN, _CC = association.column_pairs(LINEITEM.schema)


@query("pearson_pairs", _value_only([_pearson_sql("o", *p) for p in _NN]))
def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(association.pearson(LINEITEM.whole(spark, d), _NN))


@query("anova_r2_pairs", _value_only([_anova_sql("o", *p) for p in _CN]))
def anova_r2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(association.anova_r2(LINEITEM.whole(spark, d), _CN))


@query("cramers_v_pairs", _value_only([_cramer_sql("o", *p) for p in _CC]))
def cramers_v_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(association.cramers_v(LINEITEM.whole(spark, d), _CC))


@query("ols_coefficients", f"""WITH {LINEITEM.whole_sql()}, m AS (SELECT flag AS l, avg(quantity) AS m, count(*) AS n FROM o WHERE flag IS NOT NULL AND quantity IS NOT NULL GROUP BY flag), f AS (SELECT min(l) AS l FROM m)
SELECT CASE WHEN m.l = f.l THEN 'Intercept' ELSE 'flag[T.' || m.l || ']' END AS name, round(CASE WHEN m.l = f.l THEN m ELSE m - (SELECT m FROM m x WHERE x.l = f.l) END, 6) AS coefficient, n FROM m, f""")
def ols_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return rounded(association.ols_coefficients(LINEITEM.whole(spark, d), "flag", "quantity"), 6)


@query("bivariate_pairs", f"WITH {LINEITEM.sql()}, a AS ({_matrix_sql('o', LINEITEM)}), b AS ({_matrix_sql('s', LINEITEM)}) SELECT column_1, column_2, method, round(a.value, 9) AS original, round(b.value, 9) AS synthetic, round(a.value - b.value, 9) AS difference FROM a JOIN b USING (column_1, column_2, method)")
def bivariate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(association.bivariate_pairs(*LINEITEM.load(spark, d), LINEITEM.schema))


@query("bivariate_value", f"WITH {LINEITEM.sql()}, a AS ({_matrix_sql('o', LINEITEM)}), b AS ({_matrix_sql('s', LINEITEM)}), d AS (SELECT a.value - b.value AS d FROM a JOIN b USING (column_1, column_2, method)) SELECT round(sqrt(2 * sum(d * d) / 36 - pow(2 * sum(d) / 36, 2)), 9) AS value, count(*) FILTER (d IS NULL) AS n_nan_pairs, 6 AS n_columns_used FROM d")
def bivariate_value(spark: SparkSession, d: str) -> DataFrame:
    return rounded(association.bivariate_similarity(*LINEITEM.load(spark, d), LINEITEM.schema)[0])


# --- distances and neighbours ------------------------------------------------------


def _scaled_sql(plan: PairPlan, metric: str, sides: str = "os") -> str:
    """fo, fs: scaled features of both sides, as ``Features.of`` makes them; sides "o": of the one table there is."""
    if metric == "gower":
        num = [f"CASE WHEN (SELECT max({c}) - min({c}) FROM o) > 0 THEN ({c} - (SELECT min({c}) FROM o)) / (SELECT max({c}) - min({c}) FROM o) WHEN {c} IS NOT NULL THEN 0.0 END AS n{k}" for k, c in enumerate(plan.numeric)]
        cat = [f"{c} AS c{k}" for k, c in enumerate(plan.categorical)]
        return ", ".join(f"f{t} AS (SELECT row_id, {', '.join([*num, *cat])} FROM {t})" for t in sides)
    num = [f"({c} - (SELECT avg({c}) FROM o)) / coalesce(nullif((SELECT stddev_pop({c}) FROM o), 0), 1) AS z{k}" for k, c in enumerate(plan.numeric)]
    norm = "sqrt(" + " + ".join(f"z{k} * z{k}" for k in range(len(plan.numeric))) + ")"
    cat = [f"{c} AS c{k}" for k, c in enumerate(plan.categorical)]
    return ", ".join(f"f{t} AS (SELECT row_id, {', '.join([*(f'CASE WHEN {norm} > 0 THEN z{k} / {norm} ELSE 0.0 END AS n{k}' for k in range(len(plan.numeric))), *(f'c{k}' for k in range(len(plan.categorical)))])} FROM (SELECT row_id, {', '.join([*num, *cat])} FROM {t}))" for t in sides)


def _key_sql(plan: PairPlan, metric: str) -> str:
    n, c = len(plan.numeric), len(plan.categorical)
    miss = " + ".join(f"CASE WHEN a.c{k} IS NOT DISTINCT FROM b.c{k} THEN 0 ELSE 1 END" for k in range(c))
    if metric == "gower":
        total = " + ".join([*(f"coalesce(abs(a.n{k} - b.n{k}), 0.0)" for k in range(n)), f"({miss})"])
        over = " + ".join([str(c), *(f"CASE WHEN a.n{k} - b.n{k} IS NULL THEN 0 ELSE 1 END" for k in range(n))])
        return f"CAST(round_even(({total}) / ({over}) * 1e12, 0) AS BIGINT)"
    dot = " + ".join(f"a.n{k} * b.n{k}" for k in range(n))
    return f"CAST(round_even((1 - (2 * ({c} - ({miss})) - {c} + {n} * ({dot})) / {n + c}) * 1e12, 0) AS BIGINT)"


def _nn_sql(plan: PairPlan, metric: str) -> str:
    """near: row_id, nb, dk of every synthetic row; back: the same of originals among themselves."""
    key = _key_sql(plan, metric)
    return f"""WITH {plan.sql()}, {_scaled_sql(plan, metric)},
near AS (SELECT a.row_id, min(struct_pack(k := {key}, t := b.row_id)) AS m FROM fs a, fo b GROUP BY a.row_id),
back AS (SELECT a.row_id, min(struct_pack(k := {key}, t := b.row_id)) AS m FROM fo a, fo b WHERE a.row_id <> b.row_id GROUP BY a.row_id)"""


def _self_sql(plan: PairPlan, metric: str) -> str:
    """p: row_id, t, k of all pairs of different rows of the whole table; one: the nearest of each row."""
    return f"""WITH {plan.whole_sql()}, {_scaled_sql(plan, metric, "o")}, p AS (SELECT a.row_id, b.row_id AS t, {_key_sql(plan, metric)} AS k FROM fo a, fo b WHERE a.row_id <> b.row_id),
one AS (SELECT row_id, min(struct_pack(k := k, t := t)) AS m FROM p GROUP BY row_id)"""


def _self_features(spark: SparkSession, d: str, plan: PairPlan, metric: str) -> tuple[Features, DataFrame]:
    o = plan.whole(spark, d)
    f = prepare(o, plan.schema, metric)
    return f, f.of(o, "row_id")


def _features(spark: SparkSession, d: str, plan: PairPlan, metric: str) -> tuple[Features, DataFrame, DataFrame]:
    o, s = plan.load(spark, d)
    f = prepare(o, plan.schema, metric)
    return f, f.of(o, "row_id"), f.of(s, "row_id")


def _matrix_query(metric: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        f, o, s = _features(spark, d, SUPPLIER, metric)
        pairs = s.alias("a").join(o.alias("b"), F.lit(True), "cross")
        return pairs.select(F.col("a.row_id").alias("row_id"), F.col("b.row_id").alias("target"), F.round(pair_key(f) / 1e12, 9).alias("distance"))

    return run


for _metric in ("gower", "cosine"):
    query(f"{_metric}_pairs", f"WITH {SUPPLIER.sql()}, {_scaled_sql(SUPPLIER, _metric)} SELECT a.row_id, b.row_id AS target, round({_key_sql(SUPPLIER, _metric)} / 1e12, 9) AS distance FROM fs a, fo b")(_matrix_query(_metric))


@query("gower_missing_nearest", _nn_sql(EVENTS, "gower").split(",\nback AS")[0] + " SELECT count(*) AS n, CAST(sum(m.t) AS BIGINT) AS neighbours, round(avg(m.k / 1e12), 9) AS mean_distance FROM near")
def gower_missing_nearest(spark: SparkSession, d: str) -> DataFrame:
    f, o, s = _features(spark, d, EVENTS, "gower")
    near = neighbours.nearest(s, o, f)
    return near.agg(F.count("*").alias("n"), F.sum("neighbour").alias("neighbours"), F.round(F.avg(F.col("dkey") / 1e12), 9).alias("mean_distance"))


def _nn_query(metric: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        f, o, s = _features(spark, d, CUSTOMER, metric)
        return neighbours.nearest(s, o, f).select("row_id", "neighbour", F.round(F.col("dkey") / 1e12, 9).alias("distance"))

    return run


for _metric in ("gower", "cosine"):
    query(f"nn_{_metric}", _nn_sql(CUSTOMER, _metric) + " SELECT row_id, m.t AS neighbour, round(m.k / 1e12, 9) AS distance FROM near")(_nn_query(_metric))


@query("nn_self_excluded", _self_sql(CUSTOMER, "gower") + " SELECT row_id, m.t AS neighbour, round(m.k / 1e12, 12) AS distance FROM one")
def nn_self_excluded(spark: SparkSession, d: str) -> DataFrame:
    f, o = _self_features(spark, d, CUSTOMER, "gower")
    return neighbours.nearest(o, o, f, not_itself=True).select("row_id", "neighbour", F.round(F.col("dkey") / 1e12, 12).alias("distance"))


@query("knn_topk", _self_sql(CUSTOMER, "gower") + """
SELECT row_id, CAST(r - 1 AS INT) AS pos, t AS neighbour, round(k / 1e12, 12) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY k, t) AS r FROM p) WHERE r <= 5""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    f, o = _self_features(spark, d, CUSTOMER, "gower")
    return neighbours.k_nearest(o, o, f, 5, not_itself=True).select("row_id", "pos", "neighbour", F.round(F.col("dkey") / 1e12, 12).alias("distance"))


_REC = ", rec AS (SELECT n.row_id, n.m.t AS nearest_index, n.m.k AS d, b.m.k AS r FROM near n JOIN back b ON b.row_id = n.m.t)"
_RECORDS_SQL = _nn_sql(CUSTOMER, "gower") + _REC


def _records(spark: SparkSession, d: str) -> DataFrame:
    f, o, s = _features(spark, d, CUSTOMER, "gower")
    return inference.inference_records(o, s, f)


@query("inference_records", _RECORDS_SQL + " SELECT row_id, nearest_index, round(d / 1e12, 9) AS nearest_distance, round(r / 1e12, 9) AS reference_distance, d < r AS flag, d = r AS tie FROM rec")
def inference_records(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_records(spark, d))


@query("inference_risk", _RECORDS_SQL + " SELECT round(count(*) FILTER (d < r) / count(*) FILTER (d <> r), 9) AS value, count(*) FILTER (d < r) AS n_flagged, count(*) FILTER (d <> r) AS n_evaluated, count(*) FILTER (d = r) AS n_ties FROM rec")
def inference_risk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.inference_risk(_records(spark, d)))


@query("inference_distance_summary", _RECORDS_SQL + " SELECT round(avg(d / 1e12), 9) AS mean, round(min(d / 1e12), 9) AS \"min\", round(median(d / 1e12), 9) AS median, round(max(d / 1e12), 9) AS \"max\" FROM rec")
def inference_distance_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.distance_summary(_records(spark, d), "nearest_distance"))


@query("inference_distribution_p", _self_sql(CUSTOMER, "gower") + """,
two AS (SELECT one.row_id, any_value(one.m.k) AS d1, min(p.k) AS d2 FROM one JOIN p ON p.row_id = one.m.t AND p.t <> one.row_id GROUP BY one.row_id)
SELECT round(count(*) FILTER (d1 < d2) / count(*) FILTER (d1 <> d2), 9) AS p, count(*) FILTER (d1 <> d2) AS n_evaluated, count(*) FILTER (d1 = d2) AS n_ties FROM two""")
def inference_distribution_p(spark: SparkSession, d: str) -> DataFrame:
    f, o = _self_features(spark, d, CUSTOMER, "gower")
    return rounded(inference.distribution_share(o, f))


def _planner_sql(target: str, risk: float) -> str:
    """rec to row_id of the records that go, ``target`` staying, their flagged share being ``risk``."""
    return f""", c AS (SELECT count(*) FILTER (d < r) AS c1, count(*) FILTER (d > r) AS c0, count(*) FILTER (d = r) AS ct, count(*) AS n, {target} AS target FROM rec),
t AS (SELECT *, greatest(0, greatest(0, n - target) - (c1 + c0)) AS dt FROM c),
w AS (SELECT *, greatest(0, target - (ct - dt)) AS lft, greatest(0, n - target) - dt AS rest FROM t), z AS (SELECT *, CAST(round_even({risk} * lft, 0) AS BIGINT) AS t1 FROM w),
pl AS (SELECT dt, CASE WHEN rest <= 0 THEN 0 WHEN c1 - t1 >= 0 AND c0 - (lft - t1) >= 0 THEN c1 - t1 WHEN c1 - t1 < 0 THEN rest - least(c0, rest) ELSE least(c1, rest) END AS d1,
  CASE WHEN rest <= 0 THEN 0 WHEN c1 - t1 >= 0 AND c0 - (lft - t1) >= 0 THEN c0 - (lft - t1) WHEN c1 - t1 < 0 THEN least(c0, rest) ELSE rest - least(c1, rest) END AS d0 FROM z),
k AS (SELECT row_id, CASE WHEN d = r THEN 2 WHEN d < r THEN 1 ELSE 0 END AS kind, d FROM rec),
x AS (SELECT row_id, kind, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 1 THEN d ELSE -d END, row_id) AS pos FROM k)
SELECT row_id FROM x, pl WHERE pos <= CASE kind WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE dt END"""


@query("planner_selection", _RECORDS_SQL + _planner_sql("CAST(floor(count(*) * 2 / 3) AS BIGINT)", 0.5))
def planner_selection(spark: SparkSession, d: str) -> DataFrame:
    records = neighbours.kept_for_reuse(_records(spark, d))
    n = records.agg(F.count_if("flag").alias("f"), F.count_if("tie").alias("t"), F.count("*").alias("n")).first()
    plan = reduction.plan_deletions(n["f"], n["n"] - n["f"] - n["t"], n["t"], n["n"] * 2 // 3, 0.5)
    return reduction.planned_rows(records, plan)


# --- thresholds and verdicts -------------------------------------------------------


@query("simulation_summary", "SELECT count(value) AS n_valid, count(*) - count(value) AS n_invalid, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 9) AS \"min\", round(max(value), 9) AS \"max\", round(quantile_cont(value, 0.95), 9) AS quantile_value FROM (SELECT CASE WHEN event_id % 13 <> 0 THEN value END AS value FROM events)")
def simulation_summary(spark: SparkSession, d: str) -> DataFrame:
    values = spark.read.parquet(f"{d}/events.parquet").select(F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"))
    r = thresholds.simulation_summary(values, QUANTILE)
    return r.select("n_valid", "n_invalid", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *(F.round(c, 9).alias(c) for c in ("min", "max", "quantile_value")))


@query("size_correction", _GROUPS + ", p AS (SELECT sum(CASE WHEN n_o > 0 THEN CAST(n_s AS DOUBLE) / n_o ELSE 0.0 END) / sum(n_s) AS value FROM g) SELECT round(value, 9) AS value, round(1 - pow(1 - value, 2), 9) AS p_star FROM p")
def size_correction(spark: SparkSession, d: str) -> DataFrame:
    o, s = ORDERS.load(spark, d)
    return rounded(thresholds.corrected(single_out.single_out_risk(o, s, list(ORDERS.columns)).select("value")))


_CASES = [("single_out_risk", 0.2, 0.2), ("single_out_risk", 0.21, 0.2), ("inference_risk", 0.45, 0.45), ("inference_risk", 0.44, 0.45), ("pmse", 0.01, 0.02), ("bivariate_similarity", 0.05, 0.04)]


@query("judge_table", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', CAST({v} AS DOUBLE), CAST({t} AS DOUBLE), CAST({v} AS DOUBLE) {thresholds.PASS_RULES[m]} CAST({t} AS DOUBLE))" for m, v, t in _CASES) + ") x(metric, value, threshold, passed)")
def judge_table(spark: SparkSession, d: str) -> DataFrame:
    rows = [(m, v, t, thresholds.judge(m, v, {"threshold": t})["passed"]) for m, v, t in _CASES]
    return spark.createDataFrame(rows, "metric string, value double, threshold double, passed boolean")


def _numbered(spark: SparkSession, d: str, plan: PairPlan) -> DataFrame:
    """All rows of the plan's table, numbered from 0."""
    return contiguous_ids(plan.whole(spark, d).withColumnRenamed("row_id", "key"), "key").drop("key")


@query("simulate_single_out")
def simulate_single_out(spark: SparkSession, d: str) -> DataFrame:
    o = _numbered(spark, d, ORDERS)
    return thresholds.corrected(thresholds.simulate_single_out(o, list(ORDERS.columns), o.count(), thresholds.derive_seeds(SEED, SIMULATIONS)))


_SIMS = "sims AS (SELECT CAST(k AS INT) AS sim, seed FROM (VALUES " + ", ".join(f"({k}, {s})" for k, s in enumerate(thresholds.derive_seeds(SEED, SIMULATIONS))) + ") v(k, seed))"
_SPLIT_SQL = "SELECT sims.sim, o.*, md5(sims.seed || ':' || o.row_id) < '8' AS in_a FROM sims, o"


@query("simulate_single_out_hashed", f"""WITH {ORDERS.whole_sql()}, {_SIMS}, x AS ({_SPLIT_SQL}), g AS (SELECT sim, {_ORDER_KEYS}, count(*) FILTER (in_a) AS a, count(*) FILTER (NOT in_a) AS b FROM x GROUP BY sim, {_ORDER_KEYS}),
v AS (SELECT sim, sum(CASE WHEN a > 0 THEN CAST(b AS DOUBLE) / a ELSE 0 END) / sum(b) AS value FROM g GROUP BY sim) SELECT sim, round(value, 9) AS value, round(1 - pow(1 - value, 2), 9) AS p_star FROM v""")
def simulate_single_out_hashed(spark: SparkSession, d: str) -> DataFrame:
    o = ORDERS.whole(spark, d)
    return rounded(thresholds.corrected(thresholds.simulate_single_out(o, list(ORDERS.columns), None, thresholds.derive_seeds(SEED, SIMULATIONS))))


def _split_anova(c: str, x: str) -> str:
    return f"""SELECT sim, in_a, '{c}' || '{x}' AS pair, sum(n * pow(m - g, 2)) / nullif(sum(n * pow(m - g, 2)) + sum(w), 0) AS value FROM
  (SELECT sim, in_a, {c} AS l, count(*) AS n, avg({x}) AS m, var_pop({x}) * count(*) AS w FROM x WHERE {c} IS NOT NULL AND {x} IS NOT NULL GROUP BY sim, in_a, {c})
  JOIN (SELECT sim, in_a, avg({x}) AS g FROM x WHERE {c} IS NOT NULL AND {x} IS NOT NULL GROUP BY sim, in_a) USING (sim, in_a) GROUP BY sim, in_a"""


def _split_cramer(a: str, b: str) -> str:
    return f"""SELECT sim, in_a, '{a}' || '{b}' AS pair, sqrt((sum(CAST(n AS DOUBLE) * n / na / nb) - 1) / nullif(least(count(DISTINCT {a}), count(DISTINCT {b})) - 1, 0)) AS value FROM
  (SELECT *, sum(n) OVER (PARTITION BY sim, in_a, {a}) AS na, sum(n) OVER (PARTITION BY sim, in_a, {b}) AS nb FROM (SELECT sim, in_a, {a}, {b}, count(*) AS n FROM x WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY sim, in_a, {a}, {b})) GROUP BY sim, in_a"""


_PART_PAIRS = association.column_pairs(PART.schema)


@query("simulate_bivariate_hashed", f"""WITH {PART.whole_sql()}, {_SIMS}, x AS ({_SPLIT_SQL}), v AS (""" + " UNION ALL ".join([
    *(f"SELECT sim, in_a, '{a}' || '{b}' AS pair, corr({a}, {b}) AS value FROM x GROUP BY sim, in_a" for a, b in _PART_PAIRS[0]),
    *(_split_anova(*p) for p in _PART_PAIRS[1]), *(_split_cramer(*p) for p in _PART_PAIRS[2])]) + f"""), d AS (SELECT sim, pair, max(value) FILTER (in_a) - max(value) FILTER (NOT in_a) AS d FROM v GROUP BY sim, pair)
SELECT sim, round(sqrt(2 * sum(d * d) / {len(PART.columns) ** 2} - pow(2 * sum(d) / {len(PART.columns) ** 2}, 2)), 9) AS value FROM d GROUP BY sim""")
def simulate_bivariate_hashed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(thresholds.simulate_bivariate(PART.whole(spark, d), PART.schema, None, thresholds.derive_seeds(SEED, SIMULATIONS))[0])


@query("simulate_inference_hashed", f"""WITH {CUSTOMER.whole_sql()}, {_SIMS}, {_scaled_sql(CUSTOMER, "gower", "o")}, side AS (SELECT sims.sim, o.row_id, md5(sims.seed || ':' || o.row_id) < '8' AS in_a FROM sims, o),
p AS MATERIALIZED (SELECT a.row_id, b.row_id AS t, {_key_sql(CUSTOMER, "gower")} AS k FROM fo a, fo b WHERE a.row_id <> b.row_id),
first AS MATERIALIZED (SELECT x.sim, x.row_id, min(struct_pack(k := p.k, t := p.t)) AS m FROM side x JOIN p ON p.row_id = x.row_id JOIN side y ON y.sim = x.sim AND y.row_id = p.t AND y.in_a GROUP BY x.sim, x.row_id),
met AS (SELECT n.sim, n.m.k AS d, b.m.k AS r FROM first n JOIN side ON side.sim = n.sim AND side.row_id = n.row_id AND NOT side.in_a JOIN first b ON b.sim = n.sim AND b.row_id = n.m.t)
SELECT sim, round(count(*) FILTER (d < r) / count(*) FILTER (d <> r), 9) AS value, count(*) FILTER (d = r) AS n_ties FROM met GROUP BY sim""")
def simulate_inference_hashed(spark: SparkSession, d: str) -> DataFrame:
    f, o = _self_features(spark, d, CUSTOMER, "gower")
    return rounded(thresholds.simulate_inference(o, f, None, thresholds.derive_seeds(SEED, SIMULATIONS)).select("sim", "value", "n_ties"))


@query("simulate_bivariate")
def simulate_bivariate(spark: SparkSession, d: str) -> DataFrame:
    o = _numbered(spark, d, PART)
    return thresholds.simulate_bivariate(o, PART.schema, o.count(), thresholds.derive_seeds(SEED, SIMULATIONS))[0]


@query("simulate_inference")
def simulate_inference(spark: SparkSession, d: str) -> DataFrame:
    o = _numbered(spark, d, CUSTOMER)
    f = prepare(o, CUSTOMER.schema)
    return thresholds.simulate_inference(f.of(o, "row_id"), f, o.count(), thresholds.derive_seeds(SEED, SIMULATIONS))


@query("simulate_pmse")
def simulate_pmse(spark: SparkSession, d: str) -> DataFrame:
    o = _numbered(spark, d, PART)
    return spark.createDataFrame(thresholds.simulate_pmse(o, PART.schema, o.count(), thresholds.derive_seeds(SEED, SIMULATIONS)), "sim int, value double")


# --- models and reduction ----------------------------------------------------------


def _pmse_query(model: str, params: dict) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        o, s = PART.load(spark, d)
        return propensity.pmse(propensity.propensity_scores(o, s, PART.schema, model, params, row="row_id"))

    return run


for _name in ("logistic_regression", "decision_tree", "gradient_boosting"):
    query(f"pmse_{_name}")(_pmse_query(_name, {}))


def _reduce_query(method: str, options: dict) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        o, s = PART_OVERSIZED.load(spark, d)
        context = reduction.Context(o, s, PART.schema, o.count(), s.count(), SEED, options)
        return reduction.reduce_rows(method, context)[0]

    return run


_RISK = 0.45
_REDUCE_SQL = {
    "random": f"WITH {PART_OVERSIZED.sql()} SELECT row_id FROM s ORDER BY md5('{SEED}:' || row_id), row_id LIMIT (SELECT (SELECT count(*) FROM s) - (SELECT count(*) FROM o))",
    "inference_distance": _nn_sql(PART_OVERSIZED, "gower") + _REC + _planner_sql("(SELECT count(*) FROM o)", _RISK * 0.95),
}
for _name, _options in (("random", {}), ("pmse_probability", {}), ("inference_distance", {"threshold": _RISK})):
    query(f"reduce_{_name}", _REDUCE_SQL.get(_name))(_reduce_query(_name, _options))
