"""Toxicity by class-conditional Kneser-Ney models.

Two models of words (toxic, ordinary) are smoothed by one model of the whole corpus.
What is compared is the toxic and the ordinary log-likelihood of a text, normalised by
its length and calibrated to a probability.

*Counts.*  A word counts once for each document that holds it: as in Kneser-Ney's lower
orders it is the number of different contexts, not of occurrences, that tells how likely
a word is to turn up in a new one.  n_y(w) are the counts of the labelled rows of class
y, n(w) those of every document.  The beginnings of ``PREFIXES`` bytes of longer words
are counted in the same way.  All are one distributed table, a row for each word and
beginning, and grow with the corpus.

*Smoothing.*  A word is written from left to right: its beginnings are its lower orders.
With q for shares of the corpus, of each order its own, and g' for the next shorter
beginning of g (q(g) / q(g') is then how the corpus goes on from g'):

    p_y(g) = (n_y(g) - D(n_y(g))) / n_y + lambda_y p_y(g') q(g) / q(g')

where D takes all of a count of 1 and ``DISCOUNTS`` of larger ones, and lambda_y is the
mass that D took; the shortest order backs off to q alone.  So a word that a class has
hardly seen is judged by how its beginning is used, and where that is rare too, by what
the whole corpus has of it, in both classes alike, which says nothing.

*Likelihoods.*  A toxic text is mostly made of ordinary words.  So each word of it comes
from the toxic model by chance ``SHARE`` and else from the ordinary one, and the
difference of the log-likelihoods of a word is log(1 + SHARE (p_1(w) / p_0(w) - 1)).  The
ratio is taken relative to its median over the text (with ``PAD`` words that say
nothing), so that a language or subject that one class has more of is not evidence.  The
sum is divided by the number of words to the power ``LENGTH``: of 1 (the mean) and 0
(the sum) neither lets texts of all lengths be compared by one threshold.

*Calibration.*  A logistic curve over that one number, fitted to the labelled rows, each
of which is scored without its own counts.

*Labels* are a bounded sample: at most ``max_labelled`` rows of lowest hash.  What is
broadcast are their ids (9 bytes a row) and the words that at least two of them hold.

Limits: an expression is one word (scripts without spaces: one character).  Pairs of words
as a further order were tried and given up: on 14,000 documents recall at 1 % of false
alarms fell from 0.98 to under 0.1, as most pairs are too rare to tell classes apart.

Defined results: a null or empty text, or one without words, has no evidence and gets
the score of that; rows that share a doc_id are scored each, and learnt from each;
without labelled rows of both classes every score is 0; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, map_arrow
from ._text import U64, Words, chunks, mix, span

#: Taken from counts of 1, of 2, and of 3 or more.
DISCOUNTS = (1.0, 1.6, 1.8)
PREFIXES = (4, 7)
SHARE, PAD, LENGTH, FLOOR = 1e-3, 8, 0.7, 1e-4
#: Distinct words a task adds up before it passes them on.
HELD = 1 << 18
SCORED = "doc_id long, score double"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


class Letters(Words):
    """Lower-cased words: runs of a-z and characters beyond ASCII that are not punctuation; a character of scripts without spaces is a word."""

    __slots__ = ()

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: range):
        letter = _LETTER[data]
        after = np.append(data[1:], 0)
        # U+0080 to U+00BF, U+2000 to U+207F and U+3000 to U+303F, by their first bytes.
        for lead, low, high, size in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
            at = np.flatnonzero((data == lead) & (after >= low) & (after <= high))
            for k in range(size):
                letter[np.minimum(at + k, len(data) - 1)] = False
        alone = np.flatnonzero((data >= 0xE3) & (data <= 0xED) & letter)
        super().__init__(data, offsets, rows, False, ~letter, alone)

    def units(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, keys) of each order: places of the words that are longer than its beginning, and the beginnings' keys; last all words."""
        for order, size in enumerate(PREFIXES):
            long = np.flatnonzero(self.end - self.start > size)
            yield long, _key(span(self.sums, self.start[long], self.start[long] + size), order)
        yield np.arange(len(self.hash)), _key(self.hash, len(PREFIXES))


def _key(hashed: np.ndarray, order: int) -> np.ndarray:
    """62 bits of a hash and the order."""
    return (hashed & ~U64(3)) | U64(order)


def letters(column: pa.Array) -> Iterator[Letters]:
    """Words of every text of a column, run by run."""
    for data, offsets, rows in chunks(pc.utf8_lower(column.cast(pa.large_string()))):
        yield Letters(data, offsets, rows)


@dataclass(frozen=True)
class Labels:
    """A bounded sample of labelled rows, sorted by id."""

    ids: np.ndarray
    toxic: np.ndarray
    calibration: np.ndarray

    @staticmethod
    def sample(labelled: DataFrame, column: str, max_labelled: int) -> Labels:
        """At most ``max_labelled`` rows of (doc_id, column), those of lowest hash; of rows that share an id, the largest label."""
        rows = labelled.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("y"))
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toPandas().sort_values("doc_id")
        ids = rows["doc_id"].to_numpy(np.int64)
        return Labels(ids, rows["y"].to_numpy(np.int64) > 0, mix(ids.astype(np.uint64) + np.uint64(17)) % np.uint64(4) == 0)

    def find(self, ids: pa.Array) -> np.ndarray:
        """Place of each id in the sample, or -1."""
        values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(self.ids):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.ids, values), len(self.ids) - 1)
        return np.where((self.ids[at] == values) & ids.is_valid().to_numpy(zero_copy_only=False), at, -1)


class _Tally:
    """Sums of (key, three counts), kept sorted and passed on when there are too many keys."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, key: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((key, counts))
        self.size += len(key)
        if self.size > 2 * HELD:
            self._merge()

    def _merge(self) -> None:
        key, where = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        counts = np.concatenate([c for _, c in self.parts])
        total = np.stack([np.bincount(where, counts[:, k], len(key)).astype(np.int64) for k in range(3)], 1)
        self.parts, self.size = [(key, total)], len(key)

    def full(self) -> bool:
        return self.size > HELD and len(self.parts) == 1

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            key, counts = self.parts[0]
            for at in range(0, len(key), 1 << 17):
                part = counts[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 17)].view(np.int64)), *(pa.array(part[:, k].copy()) for k in range(3))], ["key", "n", "n0", "n1"])
        self.parts, self.size = [], 0


def word_counts(docs: DataFrame, labels: Labels) -> DataFrame:
    """key (of a word or beginning), n, n0, n1: in how many documents, and ordinary and toxic labelled rows, it stands."""
    shared = docs.sparkSession.sparkContext.broadcast(labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, tally = shared.value, _Tally()
        for batch in batches:
            place = labels.find(batch.column(0))
            for found in letters(batch.column(1)):
                owner = np.repeat(np.arange(len(found.rows)), np.diff(found.bounds))
                units = list(found.units())
                key, doc = np.concatenate([k for _, k in units]), np.concatenate([owner[w] for w, _ in units])
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                at = place[found.rows.start + doc[first]]
                counts = np.ones((len(at), 3), np.int64)
                counts[:, 1] = (at >= 0) & ~labels.toxic[at] if len(labels.ids) else 0
                counts[:, 2] = (at >= 0) & labels.toxic[at] if len(labels.ids) else 0
                tally.add(key[first], counts)
                if tally.full():
                    yield from tally.flush()
        yield from tally.flush()

    rows = map_arrow(docs.select("doc_id", "text"), count, "key long, n long, n0 long, n1 long")
    return rows.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1")))


def discount(n: np.ndarray) -> np.ndarray:
    """What is taken from each count."""
    return np.concatenate([[0.0], DISCOUNTS])[np.minimum(n, len(DISCOUNTS))]


@dataclass
class Order:
    """The words, or beginnings, that two or more labelled rows hold, sorted by key; ``own``: discounted share of each class over the corpus' share."""

    key: np.ndarray
    counts: np.ndarray
    shared: np.ndarray
    total: np.ndarray
    taken: np.ndarray

    def own(self, less: tuple[int, int] = (0, 0)) -> np.ndarray:
        """``less``: counts of a row that are left out; the last line is of what no row, or one row, holds."""
        n = np.maximum(self.counts - less, 0)
        return np.vstack([(n - discount(n)) / self.total / self.shared[:, None], np.zeros((1, 2))])


@dataclass
class KneserNey:
    """The two class models, from beginnings to words."""

    orders: list[Order]

    @staticmethod
    def of(table: DataFrame) -> KneserNey:
        """table: what ``word_counts`` gives, written."""
        level = F.col("key").bitwiseAND(F.lit(3)).alias("level")
        kinds = range(1, len(DISCOUNTS) + 1)
        each = [F.sum(F.when(F.col(c) == k if k < len(DISCOUNTS) else F.col(c) >= k, 1).otherwise(0)).alias(f"{c}_{k}") for c in ("n0", "n1") for k in kinds]
        sums = {r["level"]: r for r in table.groupBy(level).agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1")), *each).collect()}
        out = []
        for k in range(len(PREFIXES) + 1):
            # One order at a time, as plain arrays: 24 bytes a word.
            mine, s = table.where("n0 > 1 or n1 > 1").where(level == k).select("key", "n", F.col("n0").cast("int"), F.col("n1").cast("int")).toArrow(), sums.get(k)
            column = lambda c: mine.column(c).to_numpy()  # noqa: B023, E731
            key = column("key").view(U64)
            order = np.argsort(key)
            total = np.array([s["n0"], s["n1"]], float) if s else np.zeros(2)
            taken = np.array([sum(d * s[f"{c}_{j}"] for j, d in zip(kinds, DISCOUNTS)) for c in ("n0", "n1")], float) if s else np.ones(2)
            # A class without a beginning of this order leaves all to the order below.
            out.append(Order(key[order], np.stack([column("n0")[order], column("n1")[order]], 1), column("n")[order] / (s["n"] if s else 1), np.maximum(total, 1), np.where(total > 0, taken / np.maximum(total, 1), 1.0)))
        return KneserNey(out)


class Evidence:
    """Length-normalised differences of log-likelihoods of texts."""

    def __init__(self, model: KneserNey):
        # As counted, and for a text of class 0 and of class 1 whose own counts are left out.
        self.orders = [(o.key, np.stack([o.own(less) for less in ((0, 0), (1, 0), (0, 1))]), o.taken) for o in model.orders]

    def ratios(self, found: Letters, kind: np.ndarray) -> np.ndarray:
        """log p_1(w) / p_0(w) of each word, relative to one that neither class has seen."""
        share = np.ones((len(found.hash), 2))
        for (words, units), (key, own, taken) in zip(found.units(), self.orders):
            at = np.minimum(np.searchsorted(key, units), max(len(key) - 1, 0))
            known = key[at] == units if len(key) else np.zeros(len(at), bool)
            share[words] = own[kind[words], np.where(known, at, len(key))] + taken * share[words]
        taken = self.orders[-1][2]
        return np.log(share[:, 1]) - np.log(share[:, 0]) - np.log(taken[1] / taken[0])

    def of(self, column: pa.Array, own: np.ndarray | None = None) -> np.ndarray:
        """One number for each text; ``own``: the class of each text that was learnt from, else -1."""
        out = np.zeros(len(column))
        for found in letters(column):
            if not len(found.hash):
                continue
            n = np.diff(found.bounds)
            kind = np.zeros(len(n), np.int64) if own is None else own[found.rows.start : found.rows.stop] + 1
            ratio = self.ratios(found, np.repeat(kind, n))
            some = np.flatnonzero(n)
            usual = np.array([np.median(np.append(ratio[found.bounds[k] : found.bounds[k + 1]], np.zeros(PAD))) for k in some])
            word = np.log1p(SHARE * np.expm1(np.clip(ratio - np.repeat(usual, n[some]), -30, 30)))
            out[found.rows.start + some] = np.add.reduceat(word, found.bounds[some]) / n[some] ** LENGTH
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (intercept last) of an L2-regularised logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scale(evidence: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(evidence, 0) + FLOOR)


@dataclass
class Model:
    kn: KneserNey
    weights: np.ndarray

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        z = _scale(evidence) * self.weights[0] + self.weights[1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(docs: DataFrame, labelled: DataFrame, max_labelled: int = 100_000) -> Model | None:
    """docs: doc_id, text of the whole corpus; labelled: doc_id, toxic of the rows that may be learnt from."""
    sample = Labels.sample(labelled, "toxic", max_labelled)
    if sample.toxic.all() or not sample.toxic.any():
        return None
    store, spark = Scratch(docs.sparkSession, "toxicity"), docs.sparkSession
    table = store.put(word_counts(docs, sample), "words")
    kn = KneserNey.of(table)
    store.drop(table)
    if not (kn.orders[-1].taken > 0).all() or not len(kn.orders[-1].key):
        return None
    shared, model = spark.sparkContext.broadcast(sample), spark.sparkContext.broadcast(kn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, evidence = shared.value, Evidence(model.value)
        for batch in batches:
            own = labels.toxic[labels.find(batch.column(0))].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(evidence.of(batch.column(1), own))], ["y", "x"])

    # At most max_labelled ids.
    ids = F.broadcast(spark.createDataFrame(pa.table({"__id": sample.ids})))
    mine = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
    rows = map_arrow(mine, run, "y long, x double").toPandas()
    shared.destroy()
    model.destroy()
    if rows["y"].nunique() < 2:
        return None
    return Model(kn, logistic(_scale(rows["x"].to_numpy())[:, None], rows["y"].to_numpy(), ridge=1e-6))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic) for each row; only the text is read."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence = Evidence(model.kn)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(evidence.of(batch.column(1))))], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, SCORED)


def keep_ordinary(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns; they are judged where they are read."""
    if model is None:
        return docs
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence = Evidence(model.kn)
        for batch in batches:
            yield batch.filter(pa.array(model.probability(evidence.of(batch.column(text))) < threshold))

    return map_arrow(docs, run, docs.schema)


def remainder(doc_id: str, modulus: int):
    """crc32 of doc_id as text modulo ``modulus``: the fold of a row."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def scored_with_folds(docs: DataFrame, scores: DataFrame, held: int, modulus: int, threshold: float = 0.7) -> DataFrame:
    """The contract's columns from the operator's doc_id, score."""
    return scores.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
