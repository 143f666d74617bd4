"""Random halves of a table for many simulations at once.

A row keeps one bit a simulation, ``halves``, so a table of a hundred simulations has as
many rows as one.  Statistics of a group are vectors with one entry a simulation; they
are combined in the task that reads the rows, and by key after one shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from ..sources.workers import ship_package

#: Rows of a permutation that travel together; rows that are combined, and hashed, at a time.
BLOCK, CHUNK, HASHED = 8192, 1 << 15, 1 << 14


def split_in_a(n: int, seed: int) -> np.ndarray:
    """True for the rows of the first half of a seeded permutation."""
    out = np.zeros(n, bool)
    out[np.random.default_rng(seed).permutation(n)[: n // 2]] = True
    return out


def tasks(df: DataFrame) -> int:
    """Partitions for work that grows with rows times simulations: small files would have one task."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def kept(df: DataFrame) -> DataFrame:
    """``df`` for more than one use: in the shared folder where the session has one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


# --- MD5 over arrays: the first digit of md5("seed:row") ------------------------------

_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _low_digit(words: list[np.ndarray | int], size: int) -> np.ndarray:
    """True where the digest of one 64-byte block begins with a digit under 8; a word is an array or the same for all."""
    a, b, c, d, f, t = (np.full(size, x, np.uint32) for x in (*_START, 0, 0))
    for i in range(61):  # the last three rounds leave the first word as it is
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        if isinstance(words[g], int):
            a += np.uint32((_K[i] + words[g]) & 0xFFFFFFFF)
        else:
            a += np.uint32(_K[i])
            a += words[g]
        f += a
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=t)
        np.left_shift(f, np.uint32(_TURN[i]), out=f)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return ((b + np.uint32(_START[0])) & np.uint32(0x80)) == 0


def hashed_in_a(names: pa.Array, seeds: Sequence[int]) -> np.ndarray:
    """rows x seeds: whether md5("seed:name") < "8"."""
    out = np.empty((len(names), len(seeds)), bool)
    names = names.cast(pa.binary())
    lengths = pc.binary_length(names).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        all_of_it = np.flatnonzero(lengths == length)
        for at in range(0, len(all_of_it), HASHED):
            rows = all_of_it[at : at + HASHED]
            texts = names.take(pa.array(rows)).to_pylist()
            letters = np.frombuffer(b"".join(texts), np.uint8).reshape(len(rows), length)
            blocks: dict[int, np.ndarray] = {}
            for k, seed in enumerate(seeds):
                before = f"{seed}:".encode()
                total = len(before) + int(length)
                if total > 55:  # more than one block
                    out[rows, k] = [hashlib.md5(before + t).digest()[0] < 0x80 for t in texts]
                    continue
                if len(before) not in blocks:
                    block = np.zeros((len(rows), 64), np.uint8)
                    block[:, len(before) : total], block[:, total] = letters, 0x80
                    blocks[len(before)] = np.ascontiguousarray(block.view("<u4").T)
                fixed = np.frombuffer(before.ljust(64, b"\0"), "<u4")
                words: list[np.ndarray | int] = [
                    blocks[len(before)][w] | fixed[w] if len(before) // 4 <= w <= total // 4 else int(fixed[w]) for w in range(16)
                ]
                words[14] = 8 * total
                out[rows, k] = _low_digit(words, len(rows))
    return out


# --- rows with their halves -----------------------------------------------------------


def binaries(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of an array."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    ends = np.arange(len(raw) + 1, dtype=np.int64) * raw.shape[1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())


def matrix(column: pa.Array, dtype: str = "u1") -> np.ndarray:
    """Rows of binary values of one length."""
    if not len(column):
        return np.empty((0, 0), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def members(column: pa.Array, sims: int) -> np.ndarray:
    """rows x simulations, 1 in half A."""
    return np.unpackbits(matrix(column), axis=1, bitorder="little", count=sims) if len(column) else np.empty((0, sims), np.uint8)


def _hashed(original: DataFrame, seeds: Sequence[int]) -> DataFrame:
    columns = original.columns
    named = original.where("row_id is not null").repartition(tasks(original), "row_id").withColumn("__name", F.col("row_id").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.packbits(hashed_in_a(batch.column("__name"), seeds), axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names) if name != "__name"), binaries(bits)], names=[*columns, "halves"])

    return named.mapInArrow(run, StructType([*original.schema.fields]).add("halves", BinaryType()))


def _permuted(original: DataFrame, n: int, seeds: Sequence[int]) -> DataFrame:
    spark, sims, columns = original.sparkSession, len(seeds), original.columns
    table = spark.createDataFrame([(k, s) for k, s in enumerate(seeds)], "sim int, seed long").repartition(sims, "sim")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sim, seed in frame.itertuples(index=False):
                whole = split_in_a(n, seed)
                for at in range(0, n, BLOCK * 1024):
                    some = [np.packbits(whole[k : k + BLOCK], bitorder="little").tobytes() for k in range(at, min(n, at + BLOCK * 1024), BLOCK)]
                    yield pd.DataFrame({"block": np.arange(at // BLOCK, at // BLOCK + len(some)), "sim": np.int32(sim), "bits": some})

    def deal(rows: pa.Table, masks: pa.Table) -> pa.Table:
        ids = rows.column("row_id").to_numpy()
        bits = np.zeros((sims, BLOCK), np.uint8)
        for sim, mask in zip(masks.column("sim").to_pylist(), masks.column("bits").to_pylist()):
            part = np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little")
            bits[sim, : len(part)] = part
        halves = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")[ids % BLOCK]
        return rows.select(columns).append_column("halves", binaries(halves))

    blocks = original.where(F.col("row_id").between(0, n - 1)).withColumn("block", F.floor(F.col("row_id") / BLOCK).cast(LongType()))
    masks = table.mapInPandas(run, "block long, sim int, bits binary")
    parts = tasks(original)
    left, right = blocks.repartition(parts, "block").groupBy("block"), masks.repartition(parts, "block").groupBy("block")
    return left.cogroup(right).applyInArrow(deal, StructType([*original.schema.fields]).add("halves", BinaryType()))


def with_halves(original: DataFrame, n: int | None, seeds: Sequence[int]) -> DataFrame:
    """``original`` (with row_id) and ``halves``: a bit for every seed, set where the row is in half A.

    With n: halves of seeded permutations of row ids 0 to n-1, each made by one task.
    Without: rows of any id, each dealt by a hash of the simulation's seed and its id,
    which needs no task to know all rows; the sides are then only about equal.
    """
    ship_package(original.sparkSession)
    return _hashed(original, seeds) if n is None else _permuted(original, n, seeds)


# --- groups ---------------------------------------------------------------------------


def counted(values: np.ndarray) -> pa.Array:
    """Rows of counts, in as few bytes a count as they need."""
    top = int(values.max(initial=0))
    return binaries(values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"))


def counts(column: pa.Array, sims: int) -> np.ndarray:
    """rows x simulations, as ``counted`` wrote them."""
    out = np.empty((len(column), sims), np.int64)
    width = pc.binary_length(column).to_numpy(zero_copy_only=False) // sims
    for w in np.unique(width):
        pick = np.flatnonzero(width == w)
        out[pick] = matrix(column.take(pa.array(pick)), f"<u{w}")
    return out


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.Table]:
    """Batches put together or cut to about ``rows`` rows."""
    kept, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            kept.append(part := batch.slice(at, rows))
            n += part.num_rows
            if n >= rows:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    out = table.column(name).combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def summed(rows: DataFrame, keys: Sequence[str], sims: int, more: Sequence[str] = ()) -> DataFrame:
    """Sums by key of ``n`` (long), ``a`` (counts by simulation) and binaries of doubles ``more``; a key is one row."""
    ordered = rows.repartition(tasks(rows), *keys).sortWithinPartitions(*keys)

    def merge(table: pa.Table) -> pa.Table:
        codes = [column(table, k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
        at = starts(*codes)
        sums = [table.select(list(keys)).take(pa.array(at)).column(k) for k in keys]
        sums.append(pa.array(np.add.reduceat(column(table, "n").to_numpy(), at)))
        sums.append(counted(np.add.reduceat(counts(column(table, "a"), sims), at, axis=0)))
        for name in more:
            # Vectors of one key have one length; other keys may have others.
            vectors, ends = column(table, name).to_pylist(), [*at[1:], table.num_rows]
            sums.append(pa.array([np.sum([np.frombuffer(v) for v in vectors[i:j]], axis=0).tobytes() if j > i + 1 else vectors[i] for i, j in zip(at, ends)], pa.binary()))
        return pa.table(sums, names=[*keys, "n", "a", *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for table in chunks(batches, 4096):
            table = merge(pa.concat_tables([last, table]) if last is not None else table)
            last = table.slice(table.num_rows - 1)
            yield from table.slice(0, table.num_rows - 1).to_batches()
        if last is not None:
            yield from last.to_batches()

    kinds = {f.name: f for f in rows.schema.fields}
    return ordered.mapInArrow(run, StructType([kinds[k] for k in (*keys, "n", "a", *more)]))
