"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` is a log-structured index.  A run is a table of (key, n_docs, last_doc),
bucketed and sorted by key, so that runs are joined by merging their buckets, without a
shuffle or a sort.  Each new batch of documents is merge-anti-joined with the runs, which
gives the keys that no run holds, and is added as a run of its own; two runs of a level
are compacted into one of the next by a merge.

The table is fed in batches of falling doc_id.  So the last document that holds a key is
in the first batch that has it: the holders of fresh keys are told from all other lines by
the batch's anti-join, before anything is known of smaller ids.  What is known only at the
end is whether enough documents hold a key; the lines that a larger document holds as well
are joined with the condemned keys then.

A key is the line, ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z lower-cased;
keys under ``min_chars`` code points are never indexed.  A key in at least
``min_docs`` documents keeps its lines only in the largest doc_id holding it.

Defined results: a null or empty text is one empty line, which stays; a line repeated
within the last holder stays every time; doc_id may repeat or be null: rows of one id are
documents of their own in an order of their texts' hashes, rows without an id come last,
rows equal in id and text are one document, whose result each gets; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._rows import numbered
from ._store import Scratch, map_arrow
from ._text import SPACES

MIN_CHARS, MIN_DOCS = 20, 3
KEYS = "k1 long, k2 long, doc long"
KEPT = "doc_id long, n_lines long, n_dropped long, kept_text string"


def _keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line its 128-bit key hash, None where the key is short.

    str.encode().lower() folds A-Z only, as the key asks.
    """
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(SPACES)
        n = len(key)
        if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            out.append(xxhash.xxh3_128_digest(key))
        else:
            out.append(None)
    return out


def line_keys(own: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, doc: the distinct keys of each document of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                found, owner = [], []
                for doc, text in zip(ids[at : at + 256], batch.column(1)[at : at + 256]):
                    keys = {k for k in _keys(text.as_py(), min_chars) if k is not None}
                    found.extend(keys)
                    owner.append((doc, len(keys)))
                pair = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
                who = [d for d, n in owner for _ in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(who, pa.int64())], ["k1", "k2", "doc"])

    return map_arrow(own.select("doc", "text"), run, KEYS)


class LineRuns:
    """The levelled index: bucketed tables in the shared folder, as many buckets as the session has shuffle partitions."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs, self.store = spark, min_docs, Scratch(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        # A bucket is one file here, and is read in its order.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _run(self, rows: DataFrame) -> str:
        """Writes rows, dealt by key, as a run; its name."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").format("parquet").option("path", f"{self.store.root}/{name}").saveAsTable(name)
        return name

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds a batch (k1, k2, doc) of documents smaller than all before; k1, k2, last_doc of its keys that no run held."""
        own = rows.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        name = self._run(own.repartition(self.buckets, "k1", "k2"))
        fresh = self.spark.table(name)
        for run in self.runs():
            fresh = fresh.join(self.spark.table(run).select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti")
        out = self.store.put(fresh.select("k1", "k2", "last_doc"), "fresh")
        self._place(name, 0)
        return out

    def merged(self, one: str, two: str) -> DataFrame:
        """Two runs as one, by merging their buckets."""
        other = self.spark.table(two).select("k1", "k2", F.col("n_docs").alias("n"), F.col("last_doc").alias("last"))
        both = self.spark.table(one).join(other.hint("merge"), ["k1", "k2"], "full_outer")
        return both.select("k1", "k2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == 2:
            old, self.levels[level] = self.levels[level], []
            new = self._run(self.merged(*old))
            self._drop(*old)
            self._place(new, level + 1)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            self.store.delete(f"{self.store.root}/{name}")

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def condemned(self) -> DataFrame:
        """k1, k2 of the keys held by at least ``min_docs`` documents, over all runs; the index is closed."""
        while len(names := self.runs()) > 1:
            new = self._run(self.merged(*names[:2]))
            self._drop(*names[:2])
            self.levels = [[new, *names[2:]]]
        out = self.store.put(self.spark.table(names[0]).where(F.col("n_docs") >= self.min_docs).select("k1", "k2"), "condemned")
        self._drop(*names)
        self.levels = []
        return out


def _strip_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs: doc_id, text, gone (concatenated 16-byte key hashes, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text, gone in zip(*(part.column(i) for i in range(3))):
                    text, gone = text.as_py() or "", gone.as_py()
                    lines = text.split("\n")
                    kept = lines
                    if gone:
                        dead = set(gone)
                        kept = [x for x, k in zip(lines, _keys(text, min_chars)) if k not in dead]
                    rows.append((doc.as_py(), len(lines), len(lines) - len(kept), "\n".join(kept)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return map_arrow(docs, run, KEPT)


def dedup_lines(docs: DataFrame, batches: int = 4, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of ``docs``.

    The table is fed to the index in ``batches`` ranges of doc_id, the largest first, as a
    stream of ever older crawls would be.  What comes back to the documents is one short
    list of condemned hashes per affected document.
    """
    index = LineRuns(docs.sparkSession, min_docs)
    rows, own = numbered(docs, index.store)
    keys = index.store.put(line_keys(own, min_chars), "keys")
    cuts = keys.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    later = []
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        batch = keys.where((F.lit(True) if low is None else F.col("doc") > low) & (F.lit(True) if high is None else F.col("doc") <= high))
        fresh = index.add(batch).withColumnRenamed("last_doc", "doc")
        later.append(batch.join(fresh, ["k1", "k2", "doc"], "left_anti"))
    hits = reduce(DataFrame.unionByName, later).join(index.condemned(), ["k1", "k2"])
    code = F.unhex(F.concat(*(F.lpad(F.hex(k), 16, "0") for k in ("k1", "k2"))))
    gone = hits.select(F.col("doc").alias("__doc"), code.alias("code")).groupBy("__doc").agg(F.collect_list("code").alias("gone"))
    joined = rows.join(gone.hint("shuffle_hash"), rows["doc"] == gone["__doc"], "left").select("doc_id", "text", "gone")
    return _strip_lines(joined, min_chars)


def kept_sha256(result: DataFrame) -> DataFrame:
    """The digest columns of ``dedup_lines``' result."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> dict[int, tuple[int, int, str]]:
    """The same by dictionaries, for tests."""
    holders: dict[str, set[int]] = {}
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(SPACES.decode()).translate(fold)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= min_docs and doc < max(h))]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out
