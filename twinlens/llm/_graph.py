"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is joined to the vertex's least neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, is joined to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b").select("a", "b", "m")
    moved = joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    """Size and 128 bits of hash of a set of edges: a set that a round leaves as it is has converged."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "b", "a"))).first())


def components(edges: DataFrame, store: Scratch, name: str = "components") -> DataFrame:
    """vertex, component (its least vertex) of every vertex of an edge (a, b).

    An edge is kept once, from its smaller end; both steps look at least neighbours
    only, so a vertex with very many edges costs one combined row a partition.  Each
    round is written and reread; rounds grow with the logarithm of the longest chain.
    """
    edges = store.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    before = _fingerprint(edges)
    while True:
        after = store.put(_small_star(_large_star(edges)), name)
        store.drop(edges)
        edges, now = after, _fingerprint(after)
        if now == before:
            break
        before = now
    found = edges.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
    return found.unionByName(edges.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
