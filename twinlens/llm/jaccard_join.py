"""Exact n-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of
at least 80 %.  Linked sets share a shingle among the first ``n - ceil(0.8 n) + 1``
of each, in any fixed order of shingles; the order used here puts rare shingles
first.  Each such key is shown by its least class (its pivot); the classes that share
a key with a pivot, cut into bands of sizes that may link, are a tile.  In a tile bit
counts of bitmaps bound the overlap from above; what may link is settled there by
intersecting sorted arrays.

*Rarity* is read from a count sketch of all shingles: ``SKETCH`` cells of one byte
(log2 of the count), a fixed size whatever the input.  Any order is exact; a better
one only makes smaller tiles.

*Copies and hot groups.*  Equal sets become one class.  First the members of each tile
are verified against its pivot alone, and components are formed.  Then only classes of
different components meet: a first pass over bitmaps finds the rows of a tile that may
link with another component at all, and those rows alone bring their sorted arrays to a
second pass, which intersects them and leaves out pairs that it has connected already.
No table of pairs is made: a tile emits rows it was given, or links that form a forest.
A tile beyond ``TILE_ROWS`` or ``TILE_BYTES`` is cut into parts that meet two by two in
tasks of their own; rows of the tile's largest component need not meet one another, so
they move once for each part of the rest.

*Identity.*  Classes are told apart by 128 bits and their size.  A shingle is 64 bits,
which are only ever compared within one text or one pair of texts.  A row is found again
by a hash of its doc_id and text, and what is found is checked against its class.

Defined results: a null text, or one without words, has an empty set and links with
nothing; a text of fewer than five words is one shingle of all its words; doc_id may
repeat or be null: every row is a document of its own, a component is named by its least
doc_id that is not null (null if it has none); an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._rows import row_key, rows_of, without
from ._store import Scratch, map_arrow
from ._text import mix, prefix, span, words

NGRAM = 5
SKETCH = 1 << 20
BLOCKS = 64
TILE_ROWS, TILE_BYTES = 2048, 8 << 20
PAIRS, STEP_BYTES = 1 << 17, 4 << 20
U64 = np.uint64


def shingle_sets(texts: pa.Array, n: int = NGRAM) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for found in words(texts, fold=True):
        sums = prefix(found.hash)
        for k in range(len(found.rows)):
            a, b = int(found.bounds[k]), int(found.bounds[k + 1])
            if b - a == 0:
                yield np.empty(0, U64)
            elif b - a < n:
                yield span(sums, np.array([a]), np.array([b])) + U64(b - a)
            else:
                at = np.arange(a, b - n + 1)
                yield np.unique(span(sums, at, at + n))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> U64(44)).astype(np.int64)


def sketch(docs: DataFrame) -> np.ndarray:
    """log2 of the number of documents in each cell of shingles, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(SKETCH, np.int64), [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                waiting.append(_cell(s))
                size += len(s)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(waiting), minlength=SKETCH)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=SKETCH)
        for block in range(BLOCKS):
            part = total[block::BLOCKS]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "at": pa.array([at.astype("<u2").tobytes()], pa.binary()), "n": pa.array([part[at].astype("<u4").tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                total = sums.setdefault(row["block"], np.zeros(SKETCH // BLOCKS, np.int64))
                total[np.frombuffer(row["at"], "<u2")] += np.frombuffer(row["n"], "<u4")
        for block, total in sums.items():
            level = np.ceil(np.log2(total + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "at": pa.array([b""], pa.binary()), "n": pa.array([level.tobytes()], pa.binary())})

    schema = "block int, at binary, n binary"
    parts = map_arrow(docs.select("text"), count, schema)
    out = np.zeros(SKETCH, np.uint8)
    for row in map_arrow(parts.repartition("block"), add, schema).collect():
        out[row.block :: BLOCKS] = np.frombuffer(row.n, np.uint8)
    return out


def bitmap_bits(n: int) -> int:
    """Width of the signature of a set of n: the power of two in (n, 2n], 64 at least."""
    return max(64, 1 << int(n).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, np.uint8)
    out[(mix(s) % U64(bits)).astype(np.int64)] = 1
    return np.packbits(out)


def _least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection with which sets of n and m elements link."""
    return -((-percent * (n + m)) // (100 + percent))


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others."""
    low = int(np.bitwise_xor.reduce(mix(s ^ U64(0x5BF03635)))) + len(s) & (1 << 64) - 1
    return low, int(np.add.reduce(mix(s + U64(0x27D4EB2F))))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, U64).view(np.int64))


def with_row_key(docs: DataFrame) -> DataFrame:
    """row (a hash of the whole row that any later read gives again), doc_id, text."""
    return docs.select(row_key().alias("row"), "doc_id", "text")


def signatures(keyed: DataFrame, levels: Broadcast, percent: int) -> DataFrame:
    """row, doc_id, n, s1 and s2 (hashes of the whole set), signature, keys (the prefix of the set, rare first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            rows, size, at = [], 0, 0

            def made(at: int = 0) -> pa.RecordBatch:
                n, s1, s2, sig, keys = zip(*rows)
                part = batch.slice(at, len(rows))
                return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), _signed(s1), _signed(s2), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "n", "s1", "s2", "signature", "keys"])

            for s in shingle_sets(batch.column(2)):
                n = len(s)
                if n:
                    keep = n - -(-percent * n // 100) + 1
                    order = np.lexsort((s, level[_cell(s)]))[:keep]
                    rows.append((n, *set_hashes(s), bitmap(s, bitmap_bits(n)).tobytes(), s[order].view(np.int64)))
                else:
                    rows.append((0, 0, 0, b"", []))
                size += n
                if size > 1 << 20:
                    yield made(at)
                    at, rows, size = at + len(rows), [], 0
            if rows:
                yield made(at)

    return map_arrow(keyed, run, "row long, doc_id long, n long, s1 long, s2 long, signature binary, keys array<long>")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by its first ``keys`` columns, with the first row of each group."""
    rest: pa.Table | None = None

    def cut(table: pa.Table) -> np.ndarray:
        differs = np.zeros(max(len(table) - 1, 0), bool)
        for k in range(keys):
            v = table.column(k).to_numpy()
            differs |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(differs) + 1])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not len(table):
            continue
        first = cut(table)
        rest = table.slice(first[-1])
        if len(first) > 1:
            yield table.slice(0, first[-1]), first[:-1]
    if rest is not None and len(rest):
        yield rest, cut(rest)


class Signatures:
    """The bitmaps of a table's rows, by width; a pair is judged at the width of its smaller set."""

    def __init__(self, column: pa.ChunkedArray, n: np.ndarray):
        self.n, self.width = n, np.maximum(64, 1 << (np.frexp(n.astype(float))[1]))
        self.at = np.zeros(len(n), np.int64)
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        values = column.to_pylist()
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.at[own] = np.arange(len(own))
            bits = np.frombuffer(b"".join([values[k] for k in own.tolist()]), U64).reshape(len(own), width // 64)
            self.rows[width, width] = bits
            if width > 64:  # places are taken modulo the width, so a signature folds to half of it
                self.rows[width, width // 2] = bits[:, : width // 128] | bits[:, width // 128 :]

    def _at(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(rows), width // 64), U64)
        for own in (width, 2 * width):
            mine = self.width[rows] == own
            if mine.any():
                out[mine] = self.rows[own, width][self.at[rows[mine]]]
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """The greatest possible overlap of each pair (i, j), or -1 where it can't link."""
        n, m = self.n[i], self.n[j]
        least, out = _least_overlap(n, m, percent), np.full(len(i), -1)
        width = np.minimum(self.width[i], self.width[j])
        for bits in np.unique(width).tolist():
            at = np.flatnonzero(width == bits)
            step = max(1, STEP_BYTES * 8 // bits)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                x, y = self._at(i[part], bits), self._at(j[part], bits)
                only_x = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
                only_y = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
                bound = np.minimum(n[part] - only_x, m[part] - only_y)
                out[part] = np.where(bound >= least[part], bound, -1)
        return out


@lru_cache(maxsize=256)
def _triangle(g: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(g, 1)


def pair_blocks(first: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group, a block of about ``PAIRS`` at a time; ``first``: first row of each group."""
    held, size = [], 0
    for x, y in zip(first.tolist(), [*first[1:].tolist(), end]):
        g = y - x
        if g <= 256:
            i, j = _triangle(g)
            held.append((x + i, x + j))
            size += len(i)
            if size > PAIRS:
                yield tuple(np.concatenate(v) for v in zip(*held))
                held, size = [], 0
            continue
        step = max(1, PAIRS // g)
        for k in range(x, y - 1, step):
            i = np.arange(k, min(k + step, y - 1))
            i, j = np.repeat(i, y - x), np.tile(np.arange(x, y), len(i))
            yield i[j > i], j[j > i]
    if size:
        yield tuple(np.concatenate(v) for v in zip(*held))


class Tiles:
    """A table of whole cells (see ``dealt``) and the pairs in it that may link."""

    def __init__(self, table: pa.Table, first: np.ndarray, percent: int):
        column = {c: table.column(c).to_numpy() for c in ("comp", "n", "home", "mine", "t1", "t2")}
        self.comp, self.n, self.first, self.rows, self.percent = column["comp"], column["n"], first, len(table), percent
        self.home, self.mine, self.one = column["home"].astype(bool), column["mine"], column["t1"] == column["t2"]
        self.signatures = Signatures(table.column("signature"), self.n)

    def pairs(self, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (i, j, bound) of different components; pairs of two rows that are ``done`` (updated by the caller) are left out."""
        for i, j in pair_blocks(self.first, self.rows):
            small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
            ok = (self.comp[i] != self.comp[j]) & (100 * small >= self.percent * large) & (self.home[i] | self.home[j]) & (self.one[i] | (self.mine[i] != self.mine[j]))
            if done is not None:
                ok &= ~(done[i] & done[j])
            i, j = i[ok], j[ok]
            if len(i):
                bound = self.signatures.may_link(i, j, self.percent)
                yield i[bound >= 0], j[bound >= 0], bound[bound >= 0]


def may_meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of cells that may link with a row of another component."""
    for table, first in whole_groups(batches, 4):
        tiles, hit = Tiles(table, first, percent), np.zeros(len(table), bool)
        for i, j, _ in tiles.pairs(hit):
            hit[i] = hit[j] = True
        if hit.any():
            yield from table.select(["pivot", "band", "home", "id", "comp", "n"]).filter(pa.array(hit)).combine_chunks().to_batches()


def overlap(s: np.ndarray, t: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s):
        return 0
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


def sets_link(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = overlap(s, t)
    return both > 0 and 100 * both >= percent * (len(s) + len(t) - both)


def verified(batches: Iterator[pa.RecordBatch], percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between rows of cells, by exact intersection: those that connect components, or every one."""
    for table, first in whole_groups(batches, 4):
        tiles, ids = Tiles(table, first, percent), table.column("id").to_numpy()
        column = table.column("s")
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        found = []
        for i, j, bound in tiles.pairs():
            order = np.argsort(-bound / (tiles.n[i] + tiles.n[j] - bound), kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                a, b = root(int(tiles.comp[x])), root(int(tiles.comp[y]))
                if a != b and sets_link(np.frombuffer(column[x].as_py(), U64), np.frombuffer(column[y].as_py(), U64), percent):
                    found.append((ids[x], ids[y]))
                    if not every:
                        parent[max(a, b)] = min(a, b)
        if found:
            ends = np.sort(np.array(found, np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])


class Sets:
    """Sorted arrays of classes, made once from the text of a row of each."""

    def __init__(self, keyed: DataFrame, classes: DataFrame, store: Scratch):
        self.keyed, self.classes, self.store, self.made = keyed, classes, store, None
        self.parts: list[DataFrame] = []

    def of(self, ids: DataFrame) -> DataFrame:
        """id, s for the ids (distinct) and perhaps more; equal rows may each give one."""
        if self.made is not None:
            ids = ids.join(self.made.select("id"), "id", "left_anti")
        who = self.store.put(self.classes.join(ids, "id", "left_semi").select("id", "row", "s1", "s2"), "ids")
        if self.made is None or not who.isEmpty():
            found = rows_of(self.keyed.select("row", "text"), who.select("row").distinct(), "row").join(who, "row").select("id", "s1", "s2", "text")
            new = self.store.put(map_arrow(found, self._arrays, "id long, s binary"), "sets")
            self.parts.append(new)
            self.made = new if self.made is None else self.made.unionByName(new)
        self.store.drop(who)
        return self.made

    def written(self) -> list[DataFrame]:
        return self.parts

    @staticmethod
    def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            rows, size = [], 0
            for (k, s1, s2), s in zip(own, shingle_sets(batch.column(3))):
                mask = (1 << 64) - 1
                if k not in seen and set_hashes(s) == (s1 & mask, s2 & mask):
                    seen.add(k)
                    rows.append((k, s.tobytes()))
                    size += 8 * len(s)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "s"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "s"])


def star_links(tiles: DataFrame, sized: DataFrame, sets: Sets, store: Scratch, percent: int) -> DataFrame:
    """The links (a, b) between a pivot and the other rows of its tile."""
    one = sized.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("ga"))
    two = sized.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("gb"))
    stars = tiles.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    near = stars.join(one.drop("ga"), "a").join(two.drop("gb"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = near.join(one.select("a", "ga"), "a").join(two.select("b", "gb"), "b").select("a", "b", "na", "nb", "ga", "gb")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.chunked_array([batch.column(4), batch.column(5)])
            n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            at = np.arange(batch.num_rows)
            if len(at):
                bound = Signatures(both, n).may_link(at, at + len(at), percent)
                yield batch.select([0, 1]).filter(pa.array(bound >= 0))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [sets_link(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = store.put(map_arrow(near, bounded, "a long, b long"), "stars")
    made = sets.of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    left, right = made.select(F.col("id").alias("a"), F.col("s").alias("sa")), made.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    links = store.put(map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), intersect, "a long, b long"), "links")
    store.drop(pairs)
    return links


def mixed(rows: DataFrame, size: str) -> DataFrame:
    """pivot, band, rest, main (numbers of parts), big (the component whose rows need not meet): tiles with rows of different components.

    rows: pivot, band, home, comp, n.  ``size``: SQL of the bytes that a row brings.
    """
    each = rows.groupBy("pivot", "band", "comp").agg(F.count("*").alias("g"), F.sum(F.expr(size)).alias("bytes"), F.max("home").alias("home"))
    tile = each.groupBy("pivot", "band").agg(F.count("*").alias("comps"), F.max("home").alias("home"), F.sum("g").alias("g"), F.sum("bytes").alias("bytes"), F.max(F.struct("g", "bytes", "comp")).alias("top"))
    parts = lambda g, b: F.greatest(F.ceil(g / TILE_ROWS), F.ceil(b / TILE_BYTES)).cast("int")
    large = (F.col("g") > TILE_ROWS) | (F.col("bytes") > TILE_BYTES)
    rest = F.when(large, parts(F.col("g") - F.col("top.g"), F.col("bytes") - F.col("top.bytes"))).otherwise(1)
    main = F.when(large, parts(F.col("top.g"), F.col("top.bytes"))).otherwise(0)
    return tile.where("comps > 1 and home > 0").select("pivot", "band", rest.alias("rest"), main.alias("main"), F.col("top.comp").alias("big"))


def dealt(rows: DataFrame, size: str, *payload: DataFrame) -> DataFrame:
    """Rows of mixed tiles with their payloads (by id), dealt into cells (pivot, band, t1, t2) and sorted by them.

    A cell holds the parts t1 and t2 of a tile.  Only rows from different parts are
    pairs in it, or all where the two are one.
    """
    rows = rows.join(mixed(rows, size), ["pivot", "band"])
    for columns in payload:
        rows = rows.join(columns, "id")
    is_big = (F.col("main") > 0) & (F.col("comp") == F.col("big"))
    mine = F.when(is_big, F.col("rest") + F.pmod(F.xxhash64("id"), F.greatest("main", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), "rest")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(is_big, F.col("rest")).otherwise(F.col("rest") + F.col("main")) - 1))
    cells = rows.withColumn("mine", mine).withColumn("other", other).withColumn("t1", F.least("mine", "other")).withColumn("t2", F.greatest("mine", "other"))
    made = cells.select("pivot", "band", "t1", "t2", "mine", "home", "id", "comp", "n", *[c for p in payload for c in p.columns if c != "id"])
    return made.repartition("pivot", "band", "t1", "t2").sortWithinPartitions("pivot", "band", "t1", "t2")


def tile_links(tiles: DataFrame, sized: DataFrame, comp: DataFrame | None, sets: Sets, store: Scratch, percent: int, every: bool = False) -> DataFrame:
    """Links (a, b) of rows of the same tile and different components: enough to connect what links connect, or every one.

    comp: vertex, component (a row that has none is its own); None: every class for itself.
    """
    rows = tiles.join(sized.select("id", "n"), "id")
    if comp is None:
        rows = rows.withColumn("comp", F.col("id"))
    else:
        rows = rows.join(comp, rows["id"] == comp["vertex"], "left").select("pivot", "id", "n", F.coalesce("component", "id").alias("comp"))
    # Sizes that may link lie in the same or in neighbouring bands; a row is at home in its own and a guest in the one below.
    own = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) - 1e-9).cast("int")
    rows = rows.select("pivot", "id", "n", "comp", F.explode(F.array(F.struct(own.alias("band"), F.lit(1).alias("home")), F.struct((own - 1).alias("band"), F.lit(0).alias("home")))).alias("at")).select("pivot", "id", "n", "comp", "at.*")
    rows = store.put(rows, "rows")
    some = "pivot long, band int, home int, id long, comp long, n long"
    met = dealt(rows, "n / 4", sized.select("id", "signature"))
    met = store.put(map_arrow(met, lambda it: may_meet(it, percent), some).distinct(), "met")
    store.drop(rows)
    arrays = sets.of(met.select("id").distinct())
    cells = dealt(met, "8 * n", sized.select("id", "signature"), arrays)
    links = store.put(map_arrow(cells, lambda it: verified(it, percent, every), "a long, b long").distinct(), "links")
    store.drop(met)
    return links


class Joined:
    """What the join of a table knows: ``made`` (row, doc_id, n, s1, s2), ``classes`` (id, row, doc_id, s1, s2, n), ``links`` (a, b: class ids), ``labels`` (vertex, component)."""

    def __init__(self, made: DataFrame, classes: DataFrame, links: DataFrame, labels: DataFrame | None):
        self.made, self.classes, self.links, self.labels = made, classes, links, labels

    def components(self) -> DataFrame:
        """s1, s2, n, component_id, rep (doc_id missing, doc_id, row: the least row) of every class."""
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        own = self.classes.join(self.labels, self.classes["id"] == self.labels["vertex"], "left").drop("vertex")
        named = own.where("component is not null").groupBy("component").agg(least.alias("rep"))
        linked = own.join(named, "component", "left")
        rep = F.coalesce("rep", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        return linked.select("s1", "s2", "n", rep.alias("rep"))

    def rows(self) -> DataFrame:
        """row, doc_id, n_shingles, component_id, kept (the least row of its component, or a row that links with nothing)."""
        found = self.made.join(self.components(), ["s1", "s2", "n"], "left")
        kept = F.col("rep").isNull() | (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("row") == F.col("rep.row")))
        return found.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("component_id"), kept.alias("kept"))


def join_sets(docs: DataFrame, percent: int = 80, every: bool = False) -> Joined:
    """The join of ``docs`` (doc_id, text); ``every``: verify each link instead of those that connect components (``labels`` is None then)."""
    spark = docs.sparkSession
    store = Scratch(spark, "jaccard-join")
    keyed = with_row_key(docs)
    levels = spark.sparkContext.broadcast(sketch(docs))
    made = store.put(signatures(keyed, levels, percent), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = made.where("n > 0").groupBy("s1", "s2", "n").agg(least.alias("rep"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    classes = store.put(classes.select(F.monotonically_increasing_id().alias("id"), "rep.row", "rep.doc_id", "s1", "s2", "n", "signature", "keys"), "classes")
    levels.destroy()
    key = classes.select(F.explode("keys").alias("h"), "id")
    counted = key.groupBy("h").agg(F.count("*").alias("g"), F.min("id").alias("pivot")).where("g > 1")
    tiles = store.put(key.join(counted.select("h", "pivot"), "h").select("pivot", "id").distinct(), "tiles")
    sized = store.put(classes.join(tiles.select("id").distinct(), "id", "left_semi").select("id", "n", "signature"), "met")
    sets = Sets(keyed, classes, store)
    if every:
        links, labels = tile_links(tiles, sized, None, sets, store, percent, every=True), None
    else:
        stars = star_links(tiles, sized, sets, store, percent)
        comp = store.put(components(stars, store), "labels")
        more = tile_links(tiles, sized, comp, sets, store, percent)
        links = stars.unionByName(more)
        known = comp.select(F.col("component").alias("a"), F.col("vertex").alias("b"))
        labels = store.put(components(known.unionByName(more), store), "labels")
    store.drop(tiles, sized, *sets.written())
    return Joined(made.select("row", "doc_id", "n", "s1", "s2"), classes.select("id", "row", "doc_id", "s1", "s2", "n"), links, labels)


def all_links(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, n_shingles, class_id of each row, and every pair (a, b) of classes whose sets link.

    Rows of one class have the same set and link with one another; they are not
    expanded into pairs.  An empty set has no class.
    """
    found = join_sets(docs, percent, every=True)
    members = found.made.join(found.classes.select("s1", "s2", "n", F.col("id").alias("class_id")), ["s1", "s2", "n"], "left")
    return members.select("doc_id", F.col("n").alias("n_shingles"), "class_id"), found.links


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest doc_id that links reach."""
    return join_sets(docs, percent).rows().select("doc_id", "n_shingles", "component_id")


def keep_representatives(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group: its least row by doc_id (null last), then by a hash of the row.

    Rows that repeat a kept row in doc_id and text go too, unless their text has no words.
    """
    found = join_sets(docs, percent).rows()
    repeated = found.where("kept and n_shingles > 0").groupBy("row", "doc_id").count().where("count > 1")
    return without(docs, found.where("not kept").select("row", "doc_id").distinct(), repeated)
