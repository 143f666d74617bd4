"""Substring deduplication by FM-index shards.

A window is 20 consecutive words of one document; a word goes if a window that covers
it has a word sequence that starts earlier as well (smaller doc_id, or the same
document and an earlier start).

*Routing.*  Every window is marked by its rarest-hash run of ``GRAM`` words (its
anchor); equal windows have equal anchors.  Neighbouring windows with the same anchor
form a snippet of at most 34 words.  Copies of a snippet are combined on the map side
to the earliest one; all later ones are repeats as a whole.  The different snippets of
an anchor, each shown by its earliest copy, meet in one shard.

*Shards.*  A shard takes whole anchor groups up to about ``SHARD_WORDS`` words, builds
a compressed FM-index over them (``fm_index``) and streams its own snippets through it:
backward search gives the matching statistics (at each word, how many words up to it
occur at least twice, 20 at the most); places that reach the threshold of 20 words are
located, and those whose words occur earlier are reported as intervals.  An anchor with
more than ``HOT_SNIPPETS`` different snippets is split: its windows are routed one by
one, by their own hashes.

*Identity.*  A snippet is told from others by its anchor, its own 64 bits and its length,
so only snippets that share six words could be confused.  In a shard words are told apart
by 64 bits; windows are equal when all 20 words are.

Defined results: a null text has no words; documents of fewer than 20 words lose
nothing; windows are judged on the input, not on what is left; doc_id may repeat or be
null: rows of one id are documents of their own in an order of their texts' hashes, rows
without an id come last, rows equal in id and text are one document, whose result each
gets; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import near, numbered, rows_of
from ._store import Scratch, map_arrow
from ._text import U64, Words, chunks, prefix, span, words
from .fm_index import FmIndex
from .jaccard_join import whole_groups

WINDOW, GRAM = 20, 6
SHARD_WORDS, HOT_SNIPPETS = 1_000_000, 2_000
SPANS = "doc long, start int, len int"
KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def _runs(found: Words) -> tuple[np.ndarray, ...] | None:
    """Of the windows of a run of documents, grouped by anchor: document, first window (word place), number of windows, anchor hash, snippet hash."""
    n = len(found.hash)
    if n < WINDOW:
        return None
    sums = prefix(found.hash)
    at = np.arange(n - GRAM + 1)
    gram = span(sums, at, at + GRAM)
    wide = WINDOW - GRAM + 1
    anchor = np.arange(n - WINDOW + 1) + np.lib.stride_tricks.sliding_window_view(gram, wide).argmin(1)
    doc = np.searchsorted(found.bounds, np.arange(n - WINDOW + 1), "right") - 1
    valid = np.arange(n - WINDOW + 1) + WINDOW <= found.bounds[doc + 1]
    begins = np.ones(len(anchor), bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    start = np.flatnonzero(begins & valid)
    stop = np.flatnonzero(valid & np.append(begins[1:] | ~valid[1:], True)) + 1
    return doc[start], start, stop - start, gram[anchor[start]], span(sums, start, stop + WINDOW - 1)


def snippets(own: DataFrame) -> DataFrame:
    """h (anchor), s (snippet), doc, start (word), len (windows) of every run of windows of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for found in words(batch.column(1)):
                if (r := _runs(found)) is not None:
                    doc, start, n, h, s = r
                    who = ids[found.rows.start + doc]
                    local = (start - found.bounds[doc]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(who.astype(np.int64)), pa.array(local), pa.array(n.astype(np.int32))], ["h", "s", "doc", "start", "len"])

    return map_arrow(own.select("doc", "text"), run, "h long, s long, doc long, start int, len int")


def _with_words(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: h, doc, start, len, hot.  Adds the words' hashes; hot snippets become one row per window."""
    listed = wanted.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("h", "start", "len", "hot")).alias("found"))
    texts = rows_of(own, wanted.select("doc").distinct(), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = next(words(batch.column(1).slice(k, 1)))
                rows = batch.column(2)[k].as_py()
                sums = prefix(found.hash)
                out = []
                for r in rows:
                    a, n = r["start"], r["len"]
                    if r["hot"]:
                        at = np.arange(a, a + n)
                        key = span(sums, at, at + WINDOW).view(np.int64).tolist()
                        out += [(key[j], a + j, 1, found.hash[a + j : a + j + WINDOW].tobytes()) for j in range(n)]
                    else:
                        out.append((r["h"], a, n, found.hash[a : a + n + WINDOW - 1].tobytes()))
                if out:
                    key, start, n, sequence = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array([batch.column(0)[k].as_py()] * len(out), pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(sequence, pa.binary())], ["key", "doc", "start", "len", "words"])

    joined = texts.join(listed.hint("shuffle_hash"), texts["doc"] == listed["__doc"]).select("doc", "text", "found")
    return map_arrow(joined, run, "key long, doc long, start int, len int, words binary")


def index_and_search(doc: np.ndarray, start: np.ndarray, n: np.ndarray, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first window, windows) of the windows of a shard whose words start earlier in it as well."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    hashes = [np.frombuffer(sequences[i], U64) for i in order]
    _, code = np.unique(np.concatenate(hashes), return_inverse=True)
    length = n + WINDOW - 1
    first = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    text = np.zeros(int((length + 1).sum()), np.int64)
    place = np.repeat(first - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(len(code))
    text[place] = code + 1
    index = FmIndex(text)
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    windows = first[owner] + offset
    length, low, high = index.matching_statistics(text, windows + WINDOW, WINDOW)
    which = np.flatnonzero(length >= WINDOW)
    later = which[index.first_places(low[which], high[which]) < windows[which]]
    if not len(later):
        return doc[:0], start[:0], n[:0]
    at = start[owner[later]] + offset[later]
    cut = np.flatnonzero(np.concatenate([[True], (owner[later][1:] != owner[later][:-1]) | (np.diff(at) != 1)]))
    return doc[owner[later[cut]]], at[cut], np.diff(np.append(cut, len(later)))


def repeats_between(rows: DataFrame, n_words: int) -> DataFrame:
    """doc, start, len of repeated windows among the different snippets of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held)
            d, s, n = index_and_search(*(table.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "len")), table.column("words").to_pylist())
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "start", "len"])

        for table, first in whole_groups(batches, 1):
            # A group of one snippet repeats nothing: windows of one anchor occurrence all differ.
            sizes = np.diff(np.append(first, len(table)))
            table = table.filter(pa.array(np.repeat(sizes > 1, sizes)))
            if len(table):
                held.append(table)
                size += int(table.column("len").to_numpy().sum()) + WINDOW * len(table)
            if size > SHARD_WORDS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_words // SHARD_WORDS))
    return map_arrow(rows.repartition(shards, "key").sortWithinPartitions("key"), run, SPANS)


def removed_spans(own: DataFrame, store: Scratch) -> DataFrame:
    """doc, start, len (words): the spans of words of (doc, text) that repeat earlier windows; they may overlap."""
    found = snippets(own)
    kinds = found.groupBy("h", "s", "len").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))
    kinds = store.put(kinds.select("h", "s", "len", "first.doc", "first.start", "n"), "snippets")
    groups = store.put(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "groups")
    copied = store.put(kinds.where("n > 1").select("h", "s", "len", F.col("doc").alias("__doc"), F.col("start").alias("__start")), "copied")
    wanted = store.put(near(kinds, groups, "h").join(groups, "h").select("h", "doc", "start", "len", (F.col("kinds") > HOT_SNIPPETS).alias("hot")), "wanted")
    store.drop(kinds, groups)
    whole = near(found, copied, "s").join(copied, ["h", "s", "len"]).where("doc <> __doc or start <> __start").select("doc", "start", "len")
    n_words = wanted.agg(F.sum(F.col("len") + WINDOW)).first()[0] or 0
    between = store.put(repeats_between(_with_words(own, wanted), n_words), "between")
    store.drop(wanted)
    return whole.unionByName(between).select("doc", "start", (F.col("len") + (WINDOW - 1)).alias("len"))


def _without_spans(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, spans (list of start, len, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            spans = batch.column(2)
            for data, offsets, rows in chunks(batch.column(1)):
                found = Words(data, offsets, rows, False)
                raw = data.tobytes()
                for k, row in enumerate(rows):
                    a, b = int(found.bounds[k]), int(found.bounds[k + 1])
                    change = np.zeros(b - a + 1, np.int32)
                    if spans[row].is_valid:
                        for r in spans[row].as_py():
                            change[r["start"]] += 1
                            change[r["start"] + r["len"]] -= 1
                    stays = np.cumsum(change)[:-1] == 0 if b > a else np.zeros(0, bool)
                    at = a + np.flatnonzero(stays)
                    kept.append(b" ".join([raw[x:y] for x, y in zip(found.start[at].tolist(), found.end[at].tolist())]).decode("utf-8"))
                    n_words.append(b - a)
                    n_removed.append(b - a - len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return map_arrow(docs, run, KEPT)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of ``docs``."""
    store = Scratch(docs.sparkSession, "substring-dedup")
    rows, own = numbered(docs, store)
    spans = removed_spans(own, store).groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    joined = rows.join(spans.hint("shuffle_hash"), rows["doc"] == spans["__doc"], "left").select("doc_id", "text", "spans")
    return _without_spans(joined)


def kept_sha256(result: DataFrame) -> DataFrame:
    """The digest columns of ``dedup_substrings``' result."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by a dictionary of windows, for tests."""
    import re

    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        tokens = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = np.zeros(len(tokens), bool)
        for i in range(len(tokens) - window + 1):
            key = tuple(tokens[i : i + window])
            if key in seen:
                gone[i : i + window] = True
            seen.add(key)
        kept = " ".join(t for t, g in zip(tokens, gone) if not g)
        out[doc] = (len(tokens), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out
