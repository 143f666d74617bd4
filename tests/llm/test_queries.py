import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from test_dedup import exact_expected, near_expected
from test_models import plain_evidence
from test_rules_mix_bpe import mixture_expected

import corpus_pipeline
from twinlens.llm import queries


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def plain_logistic(x, y):
    """Intercept and slope of an unpenalised logistic regression on one number, by Newton steps."""
    z, w = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z.T * (p * (1 - p))) @ z + 1e-9 * np.eye(2), z.T @ (p - y))
    return w


def ordinary(docs, labels):
    """The rows that plain Kneser-Ney models reject not, by place."""
    label = {d: t for d, t in labels if t is not None and zlib.crc32(str(d).encode()) % 3 != 1}
    plain = plain_evidence([r.text for r in docs], [(r.text, label[r.doc_id]) for r in docs if r.doc_id in label])
    scale = lambda e: math.log(max(e, 0) + 1e-4)
    learnt = [r for r in docs if r.doc_id in label]
    a, b = plain_logistic(np.array([scale(plain(r.text, label[r.doc_id])) for r in learnt]), np.array([label[r.doc_id] for r in learnt]))
    return [k for k, r in enumerate(docs) if 1 / (1 + math.exp(-(a + b * scale(plain(r.text))))) < 0.7]


def test_pipeline_stages_against_brute_force(spark, sf):
    """Each stage on what its predecessor kept, held against plain Python."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    before = sorted(docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        texts = [r.text for r in before]
        if name == "toxicity":
            want = Counter(ordinary(before, labels))
            assert len(before) > len(want) > 0.7 * len(before)
        elif name == "exact_dedup":
            want = Counter(k for k, v in exact_expected(texts).items() if v[2])
        elif name == "jaccard_join":
            want = Counter(k for k, (_, c) in near_expected(texts).items() if c == k)
        else:
            want = Counter()
            for (k, _), n in mixture_expected([(r.doc_id, r.text, r.lang, r.source) for r in before], corpus_pipeline.MIXTURE).items():
                want[k] += n
        after = sorted(docs.collect())
        assert Counter(after) == Counter({before[k]: n for k, n in want.items()}), name
        before = after
    library = Tokenizer.from_file(queries.vocabulary())
    want = Counter()
    for r in before:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, stages["bpe"](spark, docs, sf).collect())) == want


def test_pipeline_stages_take_odd_tables(spark, sf, texts):
    """Nulls in every column, repeated and missing ids, equal rows, extra columns of any name; then an empty table."""
    names = "row doc uid kept score __path __row path tokens __gone __id __again".split()
    rows = [(None if k % 9 == 0 else k % 40, t, None if k % 4 else "en", None if k % 3 else f"src{k % 5}", None, *["x"] * len(names)) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    for found in (rows + rows[5:9] * 2, []):
        docs = spark.createDataFrame(found, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name}-{len(found)}"
            out.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            held = Counter(map(tuple, docs.collect()))
            if name in ("exact_dedup", "jaccard_join"):
                assert max(held.values(), default=0) <= 1
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_pipeline_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and {"doc_id", "n_tokens"} <= set(out.columns)
