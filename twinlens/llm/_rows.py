"""Rows of a table as documents of their own, whatever their doc_id holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

FILTER_WORDS = 1 << 17


def row_key() -> Column:
    """A hash of doc_id and text that any later read of the row gives again."""
    return F.xxhash64("doc_id", "text")


def numbered(docs: DataFrame, store: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, own): doc, doc_id, text of every row, and doc, text of every document.

    ``doc`` is a number whose order is that of doc_id.  Where ids are unique and not
    null it is doc_id itself.  Else rows of one id are ordered by a hash of the row,
    rows without an id come last, and rows equal in id and text are one document.
    """
    docs = docs.select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = docs.select(F.col("doc_id").alias("doc"), "doc_id", "text")
        return rows, rows.select("doc", "text")
    keyed = docs.select(row_key().alias("row"), "doc_id", "text")
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")]
    # Partitions are ranges, and this number grows from partition to partition and row to row.
    found = keyed.select("row", "doc_id").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    number = store.put(found.select(F.col("row").alias("__row"), F.col("doc_id").alias("__id"), F.monotonically_increasing_id().alias("doc")), "numbers")
    rows = keyed.join(number, (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc", "doc_id", "text")
    return rows, rows.select("doc", "text").dropDuplicates(["doc"])


def near(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose ``key`` (long) is in ``wanted``, and perhaps others.

    A bit table of ``FILTER_WORDS`` 64-bit words, a fixed size, goes to every executor
    and only saves moving rows that nobody needs: it passes all when far more are wanted.
    """
    spread = F.xxhash64(F.lit(5), key)
    at, bit = F.pmod(spread, F.lit(FILTER_WORDS)), F.shiftrightunsigned(spread, 58).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = wanted.select(at.alias("__at"), one.alias("__bit")).groupBy("__at").agg(F.bit_or("__bit").alias("__bits"))
    return table.join(F.broadcast(words), (at == F.col("__at")) & (F.col("__bits").bitwiseAND(one) != 0)).select(*[table[c] for c in table.columns])


def rows_of(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose ``key`` (long) is in ``wanted`` (distinct keys of that name)."""
    return near(table, wanted, key).join(wanted.select(key).hint("shuffle_hash"), key, "left_semi")


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``docs`` (all columns) without the rows in ``gone`` (row, doc_id: distinct); of equal rows in ``repeated`` (row, doc_id) one stays."""
    gone = gone.select(F.col("row").alias("__gone"), F.col("doc_id").alias("__id")).hint("shuffle_hash")
    key = F.xxhash64(docs["doc_id"], docs["text"])
    left = docs.join(gone, (key == gone["__gone"]) & docs["doc_id"].eqNullSafe(gone["__id"]), "left_anti")
    if repeated is None or repeated.isEmpty():
        return left
    name = "__row" + "_" * max(len(c) for c in docs.columns)
    again = repeated.select(F.col("row").alias("__again")).distinct()
    keyed = left.withColumn(name, row_key())
    once = keyed.join(again, keyed[name] == again["__again"], "left_semi").dropDuplicates([name, "doc_id"])
    return keyed.join(again, keyed[name] == again["__again"], "left_anti").unionByName(once).drop(name)
