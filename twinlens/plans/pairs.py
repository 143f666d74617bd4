"""Original and synthetic tables cut from the TPC-H-like test tables, for the registered queries.

Each pair has its SQL twin: common table expressions ``o`` and ``s`` for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.schema import AnalysisSchema


@dataclass(frozen=True)
class PairPlan:
    table: str
    key: str
    columns: dict[str, str]
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    original: str
    synthetic: str
    synthetic_columns: tuple[tuple[str, str], ...] = ()

    @property
    def schema(self) -> AnalysisSchema:
        return AnalysisSchema(tuple(self.columns), self.categorical, self.numeric)

    def _exprs(self, synthetic: bool) -> list[str]:
        changed = dict(self.synthetic_columns) if synthetic else {}
        return [f"{self.key} AS row_id", *(f"{changed.get(c, e)} AS {c}" for c, e in self.columns.items())]

    def load(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        base = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return base.where(self.original).selectExpr(*self._exprs(False)), base.where(self.synthetic).selectExpr(*self._exprs(True))

    def whole(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """All rows of the table, for operators of one table."""
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").selectExpr(*self._exprs(False))

    def whole_sql(self) -> str:
        return f"o AS (SELECT {', '.join(self._exprs(False))} FROM {self.table})"

    def sql(self) -> str:
        side = lambda name, where, s: f"{name} AS (SELECT {', '.join(self._exprs(s))} FROM {self.table} WHERE {where})"
        return f"{side('o', self.original, False)}, {side('s', self.synthetic, True)}"


def _halves(table: str, key: str, columns: dict[str, str], categorical: tuple[str, ...], numeric: tuple[str, ...], **more) -> PairPlan:
    return PairPlan(table, key, columns, categorical, numeric, f"{key} % 2 = 0", f"{key} % 2 = 1", **more)


ORDERS = _halves("orders", "o_orderkey", {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "price_bucket": "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING)"}, ("o_orderstatus", "o_orderpriority", "price_bucket"), ())
ORDERS_FINE = _halves("orders", "o_orderkey", {"price_bucket": "CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS STRING)"}, ("price_bucket",), ())
CAP = _halves("orders", "o_orderkey", {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "order_year": "CAST(year(o_orderdate) AS STRING)", "price_band": "CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS STRING)"}, ("o_orderstatus", "o_orderpriority", "order_year", "price_band"), ())
CUSTOMER = _halves("customer", "c_custkey", {"nation": "CAST(c_nationkey AS STRING)", "segment": "c_mktsegment", "balance": "c_acctbal"}, ("nation", "segment"), ("balance",))
SUPPLIER = _halves("supplier", "s_suppkey", {"nation": "CAST(s_nationkey AS STRING)", "balance": "s_acctbal"}, ("nation",), ("balance",))
PART = _halves("part", "p_partkey", {"brand": "p_brand", "kind": "p_type", "size": "CAST(p_size AS DOUBLE)", "price": "p_retailprice"}, ("brand", "kind"), ("size", "price"))
PART_SHIFTED = _halves("part", "p_partkey", {"brand": "p_brand", "kind": "p_type", "size": "CAST(p_size AS DOUBLE)", "price": "p_retailprice"}, ("brand", "kind"), ("size", "price"), synthetic_columns=(("size", "CAST(p_size + 10 AS DOUBLE)"),))
PART_OVERSIZED = PairPlan("part", "p_partkey", PART.columns, PART.categorical, PART.numeric, "p_partkey % 5 < 2", "p_partkey % 5 >= 2")
LINEITEM = _halves(
    "lineitem", "l_orderkey",
    {"flag": "l_returnflag", "status": "l_linestatus", "line": "CAST(l_linenumber AS STRING)", "quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"},
    ("flag", "status", "line"), ("quantity", "discount", "tax"),
)
EVENTS = _halves(
    "events", "event_id",
    {"event_type": "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '?' ELSE event_type END", "user_band": "CAST(user_id % 10 AS STRING)", "amount": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END"},
    ("event_type", "user_band"), ("amount",),
)
CONSTANT = _halves("customer", "c_custkey", CUSTOMER.columns | {"k": "1"}, ("nation", "segment"), ("balance", "k"))
