"""Quality rules by distribution divergence, with DataFrame functions only.

Each document's character-class histogram and common-word histogram are compared
with those of its language by the Jensen-Shannon distance (base 2, 0 to 1).  The
language references are sums over all documents: a language's common words are the
``TOP_WORDS`` most frequent of its short words, and both histograms are word or
character totals.  Every language has a reference of its own, however small it is.  The
references are written, one row per language, before documents are joined with them, so
that Spark knows their size: few are spread to every task, many are joined by shuffling.

Short documents have noisy histograms: the distances count only from
``min_words`` words on, and the limit is widened by ``slack / sqrt(n_words)``.

Defined results: a null text has no words; rows with a null language form a
language of their own; the only document of a language is its own reference and not far from it; white space other than ``[\\x20\\x09-\\x0D]`` belongs to words;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: The character classes of a histogram, and the class of text they are counted in.
CLASSES = {"lower": "[^a-z]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": "[^#*$%&|<>]+", "beyond_ascii": r"[\x00-\x7F]+"}
TOP_WORDS, COMMON_LENGTH, LEAST_SHARE = 24, 8, 500


@dataclass(frozen=True)
class Limits:
    """When the method rejects a document that the base rules let pass."""

    min_words: int = 40
    class_distance: float = 0.22
    word_distance: float = 0.36
    slack: float = 0.6


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the class counts.

    Everything is computed within the row.  Windows of eight words are compared by
    64-bit hashes; only documents with a hash found twice take the second step.
    """
    n, get, zero = F.size("words"), F.get, F.lit(0)
    df = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", words(F.col("text")))
    df = df.withColumn("bare", F.regexp_replace("text", f"{SPACE}+", ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")))
    df = df.withColumn("hashes", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))))
    df = df.withColumn("twice", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = F.filter("twice", lambda x, k: F.coalesce(x["h"] == F.when(k > 0, get("twice", k - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == get("twice", k + 1)["h"], F.lit(False)))
    df = df.withColumn("starts", F.array_sort(F.transform(near, lambda x: x["i"])))
    gaps = F.transform("starts", lambda x, k: F.least(F.coalesce(get("starts", k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    counts = {
        "n_words": n.cast("long"),
        "word_chars": F.length("bare").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(gaps, zero, lambda a, x: a + x), zero).cast("long"),
    }
    classes = {c: F.length(F.regexp_replace("bare", pattern, "")).cast("long") for c, pattern in CLASSES.items()}
    df = df.withColumns(counts | classes).withColumn("n_symbols", F.col("symbol"))
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def with_language(docs: DataFrame) -> DataFrame:
    """Adds language: never null, and different for a null lang and every other one."""
    return docs.withColumn("language", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))


def word_totals(docs: DataFrame) -> DataFrame:
    """language, word, n over all documents; longer words are counted together, as null."""
    word = docs.select("language", F.explode(words(F.col("text"))).alias("word"))
    return word.groupBy("language", F.when(F.length("word") <= COMMON_LENGTH, F.col("word")).alias("word")).agg(F.count("*").alias("n"))


def common_words(counted: DataFrame, store: Scratch) -> DataFrame:
    """language, common: the most frequent short words of each language.

    Only words with at least 1/500 of their language's words qualify, so a language
    has at most 500 candidates when they meet in one row.
    """
    totals = store.put(counted.groupBy("language").agg(F.sum("n").alias("total")), "totals")
    frequent = counted.where("word is not null").join(totals, "language").where(F.col("n") * LEAST_SHARE >= F.col("total"))
    ranked = frequent.groupBy("language").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "word"))).alias("found"))
    return ranked.select("language", F.transform(F.slice("found", 1, TOP_WORDS), lambda x: x["word"]).alias("common"))


def features(docs: DataFrame, store: Scratch) -> DataFrame:
    """One small row per document: language, base counts, class histogram, common-word histogram."""
    grouped = with_language(docs.select("doc_id", "text", "lang"))
    common = store.put(common_words(store.put(word_totals(grouped), "words"), store), "common")
    df = with_base(grouped.join(common, "language", "left"))
    n = F.size("words")
    hits = F.transform(F.coalesce("common", F.array().cast("array<string>")), lambda w: (n - F.size(F.array_remove("words", w))).cast("long"))
    rest = F.col("word_chars") - sum((F.col(c) for c in CLASSES), F.lit(0))
    df = df.withColumn("hits", hits)
    return df.select(
        "doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.array(*(F.col(c) for c in CLASSES), rest).alias("class_counts"),
        F.concat("hits", F.array(F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x))).alias("word_counts"),
    )


def shares(counts: Column) -> Column:
    whole = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x.cast("double"), whole), F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares (arrays of equal length), base 2."""
    part = lambda a, m: F.when((a > 0) & (m > 0), a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc_id, the counts, base_failed, kept, and both distances, for each row of ``docs``."""
    store = Scratch(docs.sparkSession, "quality-rules")
    made = store.put(features(docs, store), "features")
    summed = lambda column, k: F.array(*(F.sum(F.get(column, F.lit(i))) for i in range(k)))
    ref = made.groupBy("language").agg(summed("class_counts", len(CLASSES) + 1).alias("class_ref"), summed("word_counts", TOP_WORDS + 1).alias("word_ref"))
    ref = ref.select("language", shares(F.col("class_ref")).alias("class_ref"), shares(F.filter("word_ref", lambda x: x.isNotNull())).alias("word_ref"))
    df = made.join(store.put(ref, "references"), "language")
    df = df.withColumn("class_distance", js_distance(shares(F.col("class_counts")), F.col("class_ref"))).withColumn("word_distance", js_distance(shares(F.col("word_counts")), F.col("word_ref")))
    slack = F.lit(limits.slack) / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
    far = (F.col("class_distance") > limits.class_distance + slack) | (F.col("word_distance") > limits.word_distance + slack)
    rejected = (F.col("n_words") >= limits.min_words) & far
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
