"""Nearest neighbours in half A, for the halves of many simulations.

Lists belong to distinct records and hold the bits of their entries, so the first entry
that lies in A is found for all simulations at once.  A row keeps where in its record's
list that is, one number a simulation; rows of half B are joined with the row they chose
once for each different choice, not once for each simulation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import Features
from . import halves
from .neighbours import k_nearest, record_lists

ROWS = 2048


def in_a(sim: int) -> Column:
    """Whether a row's ``halves`` have it in half A of one simulation."""
    return F.conv(F.hex(F.substring("halves", sim // 8 + 1, 1)), 16, 10).cast("int").bitwiseAND(1 << sim % 8) != 0


def _padded(column: pa.Array, fill: int) -> np.ndarray:
    """Binaries of longs of any length, as one array."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // 8
    out = np.full((len(column), max(1, int(size.max(initial=0)))), fill, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(column.to_pylist()), "<i8")
    return out


def _places(lists: DataFrame, rows: DataFrame, sims: int) -> DataFrame:
    """query, first, second (places of the first two entries in A, -1 for none), neighbour, dkey (entries up to the last place in use)."""
    bits = rows.select(F.col("row_id").alias("neighbour"), "halves")
    entries = lists.join(bits.hint("merge"), "neighbour").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("dkey", "neighbour", "halves"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in halves.chunks(batches, 256):
            m = halves.column(table, "m")
            size, flat = pc.list_value_length(m).to_numpy(zero_copy_only=False), m.flatten()
            at = np.arange(int(size.max())) < size[:, None]
            bits = np.zeros((*at.shape, sims), bool)
            bits[at] = halves.members(flat.field("halves"), sims)
            first = np.where(bits.any(1), bits.argmax(1), -1)
            np.put_along_axis(bits, np.maximum(first, 0)[:, None], False, 1)
            second = np.where(bits.any(1), bits.argmax(1), -1)
            used = np.maximum(first, second).max(1) + 1
            cut = at & (np.arange(at.shape[1]) < used[:, None])
            values = {}
            for name in ("neighbour", "dkey"):
                whole = np.zeros(at.shape, np.int64)
                whole[at] = flat.field(name).to_numpy(zero_copy_only=False)
                values[name] = pa.array([whole[i][cut[i]].tobytes() for i in range(len(whole))], pa.binary())
            yield pa.RecordBatch.from_arrays([halves.column(table, "query"), halves.binaries(first.astype("<i2")), halves.binaries(second.astype("<i2")), values["neighbour"], values["dkey"]], names=["query", "first", "second", "neighbour", "dkey"])

    return entries.mapInArrow(run, "query long, first binary, second binary, neighbour binary, dkey binary")


def _choices(rows: DataFrame, every: DataFrame, places: DataFrame, sims: int) -> DataFrame:
    """row_id, place, dkey (its reference where it lies in A), links (chosen, d, mask of the simulations where it lies in B), open (mask: no choice there)."""
    joined = every.join(rows.hint("merge"), "row_id").join(places.hint("merge"), "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in halves.chunks(batches, ROWS):
            n = table.num_rows
            ids, a = table.column("row_id").to_numpy(), halves.members(halves.column(table, "halves"), sims).astype(bool)
            first, second = (halves.matrix(halves.column(table, c), "<i2").astype(np.int64) for c in ("first", "second"))
            neighbour, dkey = _padded(halves.column(table, "neighbour"), -1), _padded(halves.column(table, "dkey"), 0)
            itself = (first >= 0) & (np.take_along_axis(neighbour, np.maximum(first, 0), 1) == ids[:, None])
            place = np.where(itself, second, first)
            # One link for each different place that a row of B chose.
            masks, at_row, at_place = [], [], []
            for p in range(int(place.max(initial=-1)) + 1):
                here = ~a & (place == p)
                some = np.flatnonzero(here.any(1))
                masks.append(np.packbits(here[some], axis=1, bitorder="little"))
                at_row.append(some)
                at_place.append(np.full(len(some), p))
            row, p = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at_row, at_place))
            order = np.argsort(row, kind="stable")
            row, p = row[order], p[order].astype(np.int64)
            mask = np.concatenate(masks)[order] if masks else np.empty((0, (sims + 7) // 8), np.uint8)
            links = pa.StructArray.from_arrays([pa.array(neighbour[row, p]), pa.array(dkey[row, p]), halves.binaries(mask) if len(mask) else pa.array([], pa.binary())], names=["chosen", "d", "mask"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
            none = np.packbits(~a & (place < 0), axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array(ids), halves.binaries(np.where(a, place, -1).astype("<i2")), halves.column(table, "dkey"), pa.ListArray.from_arrays(pa.array(ends), links), pa.array([x.tobytes() if x.any() else None for x in none], pa.binary())], names=["row_id", "place", "dkey", "links", "open"])

    return joined.mapInArrow(run, "row_id long, place binary, dkey binary, links array<struct<chosen:long,d:long,mask:binary>>, open binary")


def half_neighbours(original: DataFrame, f: Features, n: int | None, seeds: list[int], k: int) -> tuple[DataFrame, int]:
    """(sim, records, ties, flags; how many searches the lists of ``k`` neighbours left open).

    A record of half B is flagged where it is nearer to its neighbour in A than that one is
    to its own; what the lists leave open is searched in full.
    """
    sims = len(seeds)
    rows = halves.kept(halves.with_halves(original.select("row_id"), n, seeds))
    every, lists = record_lists(original, f, k + 1)
    choices = halves.kept(_choices(rows, every, _places(lists, rows, sims), sims))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in halves.chunks(batches, ROWS):
            row, sim = np.nonzero(halves.members(halves.column(table, "open"), sims))
            yield pa.RecordBatch.from_arrays([pa.array(sim.astype(np.int32)), pa.array(table.column("row_id").to_numpy()[row])], names=["sim", "row_id"])

    def searched(open_: DataFrame, spare: int) -> tuple[list[DataFrame], int]:
        """(sim, row_id, neighbour, dkey) of each simulation with open rows.

        All these searches are one plan: a broadcast side of each would be held at once.
        """
        out, count = [], 0
        for s, rows_of in sorted((r["sim"], r["count"]) for r in open_.groupBy("sim").count().collect()):  # at most one row a simulation
            count += rows_of
            some = original.join(open_.where(F.col("sim") == s).select("row_id").hint("merge"), "row_id", "left_semi")
            near = k_nearest(some, original.join(rows.where(in_a(s)).select("row_id").hint("merge"), "row_id", "left_semi"), f, spare, how="merge").where("row_id <> neighbour")
            out.append(near.groupBy("row_id").agg(F.min(F.struct("dkey", "neighbour")).alias("m")).select(F.lit(s).alias("sim"), "row_id", "m.neighbour", "m.dkey"))
        return out, count

    links = choices.select(F.inline("links"))
    found, missed = searched(halves.kept(choices.where("open is not null").select("row_id", "open").mapInArrow(opened, "sim int, row_id long")), 1)
    masks = F.array(*(F.lit(bytes(1 << s % 8 if i == s // 8 else 0 for i in range((sims + 7) // 8))) for s in range(sims)))
    for near in found:
        links = links.unionByName(near.select(F.col("neighbour").alias("chosen"), F.col("dkey").alias("d"), masks[F.col("sim")].alias("mask")))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts by simulation; records whose neighbour's reference is open come as they are, with the neighbour."""
        total = np.zeros((3, sims), np.int64)
        names = ["sim", "records", "ties", "flags", "row_id", "d"]
        for table in halves.chunks(batches, ROWS):
            place = halves.matrix(halves.column(table, "place"), "<i2").astype(np.int64)
            reference = np.take_along_axis(_padded(halves.column(table, "dkey"), 0), np.maximum(place, 0), 1)
            here, d = halves.members(halves.column(table, "mask"), sims).astype(bool), table.column("d").to_numpy()
            row, sim = np.nonzero(here & (place < 0))
            if len(row):
                none = pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(sim.astype(np.int32)), none, none, none, pa.array(table.column("chosen").to_numpy()[row]), pa.array(d[row])], names=names)
            here &= place >= 0
            total += [here.sum(0), (here & (d[:, None] == reference)).sum(0), (here & (d[:, None] < reference)).sum(0)]
        none = pa.nulls(sims, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sims, dtype=np.int32)), *map(pa.array, total), none, none], names=names)

    references = choices.select(F.col("row_id").alias("chosen"), "place", "dkey")
    both = halves.kept(links.join(references.hint("merge"), "chosen").mapInArrow(judged, "sim int, records long, ties long, flags long, row_id long, d long"))
    counts, still = both.where("row_id is null").select("sim", "records", "ties", "flags"), both.where("row_id is not null")
    found, missed_back = searched(still.select("sim", "row_id").distinct(), 2)
    for back in found:
        met = still.select("sim", "row_id", "d").join(back.select("sim", "row_id", F.col("dkey").alias("r")).hint("merge"), ["sim", "row_id"])
        counts = counts.unionByName(met.select("sim", F.lit(1).alias("records"), (F.col("d") == F.col("r")).cast("long").alias("ties"), (F.col("d") < F.col("r")).cast("long").alias("flags")))
    return counts.groupBy("sim").agg(*(F.sum(c).alias(c) for c in ("records", "ties", "flags"))).where("records > 0"), missed + missed_back
