"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

The normalised text (white space deleted) is cut where its content says so, each
chunk becomes an identifier of 128 bits, and a document becomes the ordered list of its
identifiers (its recipe).  Identifiers are verified over the whole corpus: of distinct
chunks that share one, each gets a rank, and documents that hold such chunks add the
ranks to their recipe, so equal recipes are equal texts.  Long texts move at most once
(their distinct chunks, combined on the map side); grouping and choosing the row that
stays move recipes only.

Defined results: a null text counts as empty; empty texts are equal to each other (their
recipe is the empty list); doc_id may repeat or be null: of equal texts with most code
points the row of the smallest doc_id stays (null last), then that of the least hash of
id and text, and of rows equal in both any one, so that one row of each group stays; an
empty table gives an empty result; other columns pass by untouched, whatever they are
called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._rows import row_key, without
from ._store import Scratch

#: White space that is deleted before texts are compared.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Chunks have at least MIN_CHUNK characters and at most MAX_CHUNK; after the minimum, a
#: chunk ends behind the first vowel-consonant-vowel-consonant run of these letters or
#: the first punctuation mark of any script.
MIN_CHUNK, MAX_CHUNK = 384, 4096
CUT = r"(?<=[aeiou][bcdfghlmnprst][aeiou][bcdfghlmnprst]|\p{P})"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "")


def chunked(norm: Column) -> Column:
    """Ordered content-defined chunks of a normalised text; their concatenation is the text."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?{CUT}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def _identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(0), chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


def recipes(docs: DataFrame) -> DataFrame:
    """uid, row, doc_id, n_chars, text_sha256 and the ordered identifiers of each document; no shuffle.

    uid numbers the rows of one run; it is fixed by writing the table.
    """
    norm = docs.select(row_key().alias("row"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    return norm.select(
        F.monotonically_increasing_id().alias("uid"),
        "row",
        "doc_id",
        "n_chars",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunked(F.col("norm")), _identifier).alias("recipe"),
    )


def distinct_chunks(docs: DataFrame) -> DataFrame:
    """id, chunk: each distinct chunk is moved once."""
    return docs.select(F.explode(chunked(normalised(F.col("text")))).alias("chunk")).select(_identifier(F.col("chunk")).alias("id"), "chunk").distinct()


def shared_identifiers(docs: DataFrame) -> DataFrame:
    """The identifiers that stand for more than one chunk content."""
    return distinct_chunks(docs).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def ranked_chunks(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """id, chunk, rank: the distinct chunks of shared identifiers but the least one of each."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("chunk")) - 1
    return distinct_chunks(docs).join(shared, "id", "left_semi").withColumn("rank", rank).where("rank > 0")


def _with_ranks(made: DataFrame, docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds ranks: place and rank of each of a document's chunks that is in ``ranked``."""
    norm = docs.select(row_key().alias("row"), "doc_id", normalised(F.col("text")).alias("norm"))
    chunk = norm.select("row", F.sha2("norm", 256).alias("text_sha256"), F.posexplode(chunked(F.col("norm"))).alias("place", "chunk"))
    held = chunk.withColumn("id", _identifier(F.col("chunk"))).join(ranked, ["id", "chunk"])
    ranks = held.groupBy("row", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("place", "rank"))).alias("ranks"))
    return made.join(ranks, ["row", "text_sha256"], "left")


def _grouped(docs: DataFrame) -> DataFrame:
    """uid, row, doc_id, text_sha256 of each row, keep (of the row that stays) and group_size of its group."""
    docs = docs.select("doc_id", "text")
    store = Scratch(docs.sparkSession, "exact-dedup")
    shared = store.put(shared_identifiers(docs), "shared")
    made = store.put(recipes(docs), "recipes")
    if shared.isEmpty():
        made = made.withColumn("ranks", F.lit(None).cast("array<struct<place:int,rank:int>>"))
    else:
        made = store.put(_with_ranks(made, docs, store.put(ranked_chunks(docs, shared), "ranked")), "ranked-recipes")
    made = made.withColumn("ranks", F.coalesce("ranks", F.array().cast("array<struct<place:int,rank:int>>")))
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("none"), "doc_id", "row", "uid")
    groups = made.groupBy("recipe", "ranks").agg(F.min(order).alias("keep"), F.count("*").alias("group_size"))
    # Written first, so that the join stands alone on its exchanges and a hot recipe can be split.
    return made.join(store.put(groups, "groups"), ["recipe", "ranks"])


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with most code points in the original text stays, then
    the smallest doc_id.
    """
    return _grouped(docs).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text stays, with all their columns: one row of each group.

    Rows that go are few next to the texts, so their hashes are what is spread: the
    text side is hashed once.
    """
    found = _grouped(docs)
    stays = (F.col("row") == F.col("keep.row")) & F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
    repeated = found.where(stays).groupBy("row", "doc_id").count().where("count > 1")
    return without(docs, found.where(~stays).select("row", "doc_id").distinct(), repeated)
