"""Thin registered queries of the operators: whole tables in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workers import ship_package
from . import bpe, exact_dedup, html_extract, jaccard_join, line_dedup, mixing, quality_classifier, quality_rules, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


#: Half of the corpus' tokens, domains by given weights, English twice as heavy as each other language in the first.
MIXTURE = mixing.Plan(weights={("domain0",): 2.0, ("domain1",): 1.0, ("domain2",): 1.0, ("domain3",): 0.5, ("domain0", "en"): 2.0}, share=0.5, max_epochs=4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the word-level vocabulary; the file is a parameter of the operator and lies outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def learnable(labels: DataFrame, modulus: int, held: int) -> DataFrame:
    """The labelled rows outside the held-out fold."""
    return labels.where(toxicity.remainder("doc_id", modulus) != held)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, learnable(table(spark, sf_dir, "labels"), 3, 1))
    return toxicity.scored_with_folds(docs, toxicity.score(docs, model), 1, 3)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path, tokens, epoch = mixing.added_names(docs)
    levels = [F.get(path, F.lit(k)).alias(name) for k, name in enumerate(mixing.LEVELS)]
    return mixing.select_mixture(docs, MIXTURE).select("doc_id", *levels, F.col(tokens).alias("n_tokens"), F.col(epoch).alias("epoch"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_sha256(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_sha256(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, learnable(table(spark, sf_dir, "labels"), 4, 2))
    return toxicity.scored_with_folds(docs, quality_classifier.score(docs, model), 2, 4)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [op1_toxicity, op2_mixing, op3_line_dedup, op4_quality_rules, op5_jaccard_join, op6_html_extract, op7_substring_dedup, op8_bpe, op9_quality_classifier, op10_exact_dedup]

    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in found}


_KEYED = r"""
lines AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines)
"""

_CLASSES = ["[^a-z]", "[^A-Z]", "[^0-9]", "[^#*$%&|<>]", "ascii"]
_BARE = r"regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')"
_CLASS_COUNTS = ", ".join(rf"length(regexp_replace(bare, '{'[' + chr(92) + 'x00-' + chr(92) + 'x7F]' if c == 'ascii' else c}', '', 'g'))" for c in _CLASSES)


def _js_distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    part = lambda a, b: f"CASE WHEN {a}[k] > 0 THEN {a}[k] * log2({a}[k] / (({a}[k] + {b}[k]) / 2)) ELSE 0 END"  # noqa: E731
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda k: {part(p, q)} + {part(q, p)})) / 2, 0))"


_SHARES = "list_transform({0}, lambda x: CASE WHEN list_sum({0}) > 0 THEN x / list_sum({0}) ELSE 0 END)"

ORACLE_SQL = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS language, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_BARE} AS bare, list_filter(regexp_split_to_array(text, '[ 	-]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS t FROM w WHERE len(ws) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + j.k) AS n_repeat_words FROM twice, range(8) j(k) GROUP BY doc_id),
word AS (SELECT language, word, count(*) AS n FROM (SELECT language, unnest(ws) AS word FROM w) GROUP BY language, word),
common AS (SELECT language, word, row_number() OVER (PARTITION BY language ORDER BY n DESC, word) AS k
           FROM word JOIN (SELECT language, sum(n) AS total FROM word GROUP BY language) USING (language) WHERE length(word) <= 8 AND n * 500 >= total),
top AS (SELECT language, list(word ORDER BY k) AS words FROM common WHERE k <= 24 GROUP BY language),
c AS (SELECT w.doc_id, language, len(ws) AS n_words, length(bare) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, [{_CLASS_COUNTS}] AS five,
             list_transform(coalesce(words, []), lambda v: len(list_filter(ws, lambda x: x = v))) AS hits
      FROM w LEFT JOIN top USING (language) LEFT JOIN again ON again.doc_id = w.doc_id),
h AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             list_append(five, word_chars - list_sum(five)) AS cc, list_append(hits, n_words - coalesce(list_sum(hits), 0)) AS wc FROM c),
cref AS (SELECT language, list(total ORDER BY k) AS cr FROM (SELECT language, k, sum(n) AS total FROM (SELECT language, unnest(cc) AS n, unnest(range(len(cc))) AS k FROM h) GROUP BY language, k) GROUP BY language),
wref AS (SELECT language, list(total ORDER BY k) AS wr FROM (SELECT language, k, sum(n) AS total FROM (SELECT language, unnest(wc) AS n, unnest(range(len(wc))) AS k FROM h) GROUP BY language, k) GROUP BY language),
s AS (SELECT h.*, {_SHARES.format("cc")} AS cp, {_SHARES.format("cr")} AS cq, {_SHARES.format("wc")} AS wp, {_SHARES.format("wr")} AS wq FROM h JOIN cref USING (language) JOIN wref USING (language)),
j AS (SELECT *, {_js_distance("cp", "cq")} AS cd, {_js_distance("wp", "wq")} AS wd, 0.6 / sqrt(greatest(n_words, 1)) AS slack FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= 40 AND (cd > 0.22 + slack OR wd > 0.36 + slack)) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM j""",
    "op3_line_dedup": f"""
WITH {_KEYED},
dead AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < d.last_doc, false) AS gone FROM keyed k LEFT JOIN dead d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.r) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.v = d.doc_id GROUP BY d.doc_id, n.n""",
    "op7_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS t FROM w WHERE len(ws) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j.k AS i FROM later, range(20) j(k)),
tok AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT t.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(t.word, ' ' ORDER BY t.i) FILTER (WHERE g.i IS NULL) AS kept
         FROM tok t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
      count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
