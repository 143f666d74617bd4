"""Nearest-neighbour joins under a mixed distance, exact, with ties to the smallest row.

Two records that differ in a category are at least one mismatch apart.  So records are
first dealt into buckets by their categories, and each query looks through its own bucket
only; where its k nearest there are closer than one mismatch, nothing outside can be
nearer, and the query is closed.  That work grows with the records, not with their
product.  Only queries that stay open are held against all targets, in pairs of blocks.

Equal records are collapsed on both sides; buckets and sides are dealt into blocks of
about ``BLOCK`` records, and every pair of blocks is one group of a co-grouped task that
works on NumPy arrays.  A query keeps only its k best per block pair, and these partial
answers are merged by one aggregation.  Nothing is collected; a broadcast may carry the
block counts, one row a bucket, but no records: their estimated size says little of copies
that compress well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import SCALE, Features, block_keys
from ..sources.workers import ship_package

BLOCK, BUCKET = 4096, 1024


def _distinct(df: DataFrame, f: Features, ids: int) -> DataFrame:
    """Distinct records with their ``ids`` smallest row ids."""
    if ids == 1:
        return df.groupBy(*f.names).agg(F.array(F.min("row_id")).alias("rows"))
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(*f.names).orderBy("row_id"))).where(F.col("__k") <= ids)
    return ranked.groupBy(*f.names).agg(F.sort_array(F.collect_list("row_id")).alias("rows"))


def _arrays(f: Features, a: pd.DataFrame, b: pd.DataFrame) -> list[np.ndarray]:
    """Numbers and category codes of two frames, coded together."""
    n, c = f.names[: f.n_numeric], f.names[f.n_numeric :]
    codes = np.zeros((len(a) + len(b), len(c)), np.int32)
    for k, name in enumerate(c):
        codes[:, k] = pd.factorize(pd.concat([a[name], b[name]]), use_na_sentinel=True)[0]
    return [a[n].to_numpy(float), codes[: len(a)], b[n].to_numpy(float), codes[len(a) :]]


def _least_mismatch(f: Features) -> int:
    """A distance key that no pair with different categories stays under."""
    return int((1 if f.metric == "gower" else 2) * SCALE / (f.n_numeric + f.n_categorical)) - 2


def kept_for_reuse(df: DataFrame) -> DataFrame:
    """``df`` for more than one use: in the shared folder where the session has one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _dealt(own: DataFrame, other: DataFrame, f: Features, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (b, qb, tb): bucket, block of queries, block of targets; a pair of one bucket meets once."""
    h = F.xxhash64(*f.names)
    # A category that is missing hashes like nothing; a marker keeps it apart.
    kind = F.xxhash64(*(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in f.names[f.n_numeric :])) if f.n_categorical else F.lit(0)
    b = F.pmod(kind, F.lit(buckets)).cast("int") if buckets > 1 else F.lit(0)
    own, other = own.withColumn("b", b), other.withColumn("b", b)
    blocks = lambda df, name: df.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = kept_for_reuse(blocks(own, "nq").join(blocks(other, "nt"), "b"))
    left, right = own.join(sizes, "b"), other.join(sizes, "b")
    left = left.withColumn("qb", F.pmod(h, F.col("nq")).cast("int")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
    right = right.withColumn("tb", F.pmod(h, F.col("nt")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    # Co-grouping names columns by their frame: fresh ones keep a table apart from itself.
    return tuple(x.drop("nq", "nt").select(*(F.col(c).alias(c) for c in x.columns if c not in ("nq", "nt"))) for x in (left, right))


def _found(own: DataFrame, other: DataFrame, f: Features, spare: int, buckets: int) -> DataFrame:
    """query, dkey, neighbour: the ``spare`` best targets of each query in each pair of blocks of its bucket."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": np.empty(0, np.int64), "dkey": np.empty(0, np.int64), "neighbour": np.empty(0, np.int64)})
        qn, qc, tn, tc = _arrays(f, a, b)
        first = np.array([r[0] for r in b["rows"]], np.int64)
        order = np.argsort(first, kind="stable")
        rows = [b["rows"].iat[i] for i in order]
        tn, tc, first = tn[order], tc[order], first[order]
        out_q, out_d, out_t = [], [], []
        step = max(1, (1 << 22) // len(b))
        for at in range(0, len(a), step):
            key = block_keys(f, qn[at : at + step], qc[at : at + step], tn, tc)
            if spare == 1:
                pick = key.argmin(1)
                out_q.append(a["query"].to_numpy()[at : at + step])
                out_d.append(key[np.arange(len(key)), pick])
                out_t.append(first[pick])
                continue
            # Records whose distance is among the spare smallest, their equal rows expanded.
            need = min(spare, key.shape[1])
            limit = np.partition(key, need - 1, axis=1)[:, need - 1]
            for i in range(len(key)):
                near = np.flatnonzero(key[i] <= limit[i])
                t = np.concatenate([rows[j] for j in near]).astype(np.int64)
                d = np.repeat(key[i][near], [len(rows[j]) for j in near])
                keep = np.lexsort((t, d))[:spare]
                out_q.append(np.full(len(keep), a["query"].iat[at + i]))
                out_d.append(d[keep])
                out_t.append(t[keep])
        return pd.DataFrame({"query": np.concatenate(out_q), "dkey": np.concatenate(out_d), "neighbour": np.concatenate(out_t)})

    left, right = _dealt(own, other, f, buckets)
    return left.groupBy("b", "qb", "tb").cogroup(right.groupBy("b", "qb", "tb")).applyInPandas(best, "query long, dkey long, neighbour long")


def _merged(found: DataFrame, spare: int) -> DataFrame:
    """The ``spare`` best of each query over all its blocks."""
    if spare == 1:
        return found.groupBy("query").agg(F.min(F.struct("dkey", "neighbour")).alias("b")).select("query", "b.dkey", "b.neighbour")
    return found.withColumn("__r", F.row_number().over(Window.partitionBy("query").orderBy("dkey", "neighbour"))).where(F.col("__r") <= spare).drop("__r")


def _candidates(own: DataFrame, other: DataFrame, f: Features, spare: int) -> DataFrame:
    """query, dkey, neighbour: the ``spare`` nearest targets of each query."""
    buckets = -(-other.count() // BUCKET) if f.n_categorical else 1
    if buckets <= 1:
        return _merged(_found(own, other, f, spare, 1), spare)
    inside = kept_for_reuse(_merged(_found(own, other, f, spare, buckets), spare))
    closed = inside.groupBy("query").agg(F.count("*").alias("n"), F.max("dkey").alias("far")).where((F.col("n") == spare) & (F.col("far") < _least_mismatch(f))).select("query")
    open_ = kept_for_reuse(own.join(closed.hint("merge"), "query", "left_anti"))
    done = inside.join(closed.hint("merge"), "query", "left_semi")
    return done if open_.isEmpty() else done.unionByName(_merged(_found(open_, other, f, spare, 1), spare))


def _records(rows: DataFrame, f: Features, how: str = "") -> tuple[DataFrame, DataFrame]:
    """(distinct records with ``query``, their smallest row id; row_id and query of every row).  ``how``: a join hint."""
    own = rows.groupBy(*f.names).agg(F.min("row_id").alias("query"))
    every = rows.select("row_id", *(F.col(c).alias(f"__q_{c}") for c in f.names))
    known = own.select("query", *(F.col(c).alias(f"__k_{c}") for c in f.names))
    same = F.lit(True)
    for c in f.names:
        same = same & F.col(f"__q_{c}").eqNullSafe(F.col(f"__k_{c}"))
    return own, every.join(known.hint(how) if how else known, same).select("row_id", "query")


def record_lists(rows: DataFrame, f: Features, k: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, query; query, dkey, neighbour): for each distinct record its ``k`` nearest rows, its own rows among them."""
    ship_package(rows.sparkSession)
    own, every = _records(rows, f, "merge")
    return every, _candidates(own, _distinct(rows, f, k), f, k)


def k_nearest(queries: DataFrame, targets: DataFrame, f: Features, k: int = 1, not_itself: bool = False, how: str = "") -> DataFrame:
    """row_id, pos (0 first), neighbour, dkey: the k nearest targets of each query in (distance, row) order.

    ``not_itself``: both frames are the same table, and a row is no neighbour of itself.
    ``how``: a join hint for what is as long as the queries.
    """
    ship_package(queries.sparkSession)
    spare = k + int(not_itself)
    own, every = _records(queries, f, how)
    merged = _candidates(own, _distinct(targets, f, spare), f, spare)
    # Back to every query row of an equal record.
    joined = every.join(merged.hint(how) if how else merged, "query")
    if k == 1 and not not_itself:
        return joined.select("row_id", F.lit(0).alias("pos"), "neighbour", "dkey")
    if not_itself:
        joined = joined.where("row_id <> neighbour")
    ranked = joined.withColumn("pos", F.row_number().over(Window.partitionBy("row_id").orderBy("dkey", "neighbour")) - 1)
    return ranked.where(F.col("pos") < k).select("row_id", "pos", "neighbour", "dkey")


def nearest(queries: DataFrame, targets: DataFrame, f: Features, not_itself: bool = False) -> DataFrame:
    """row_id, neighbour, dkey."""
    return k_nearest(queries, targets, f, 1, not_itself).select("row_id", "neighbour", "dkey")
