import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from twinlens.llm import _text, html_extract, html_pages, quality_classifier, toxicity
from twinlens.llm.gbt import BoostedTrees


def plain_evidence(corpus, learnt):
    """Kneser-Ney by dictionaries: a function of (text, class it was learnt from or None)."""
    split = lambda t: [w.encode() for w in re.findall("[a-z\u00c0-\u1fff]+", (t or "").lower())]
    units = lambda w: [(k, w[:k]) for k in (4, 7) if len(w) > k] + [("word", w)]
    held = lambda t: {u for w in split(t) for u in units(w)}
    n = Counter(u for t in corpus for u in held(t))
    own = [Counter(u for t, y in learnt if y == k for u in held(t)) for k in (0, 1)]
    take = lambda c: {0: 0, 1: 1.0, 2: 1.6}.get(c, 1.8)
    order = lambda counts, k: {u: c for u, c in counts.items() if u[0] == k}
    size = [{k: sum(order(c, k).values()) for k in (4, 7, "word")} for c in own]
    mass = [{k: sum(map(take, order(c, k).values())) / s[k] if s[k] else 1 for k in s} for c, s in zip(own, size)]
    whole = {k: sum(order(n, k).values()) for k in (4, 7, "word")}

    def p(y, w, less):
        lower = None
        for u in units(w):
            c, q = max(own[y][u] - less, 0), n[u] / whole[u[0]]
            smooth = q if lower is None else lower[0] * q / lower[1]
            lower = ((c - take(c)) / max(size[y][u[0]], 1) + mass[y][u[0]] * smooth, q)
        return lower[0]

    def evidence(text, label=None):
        r = [math.log(p(1, w, label == 1) / p(0, w, label == 0)) - math.log(mass[1]["word"] / mass[0]["word"]) for w in split(text)]
        usual = statistics.median([*r, *[0.0] * 8])
        return sum(math.log(1 + 0.001 * (math.exp(x - usual) - 1)) for x in r) / len(r) ** 0.7 if r else 0.0

    return evidence


def test_kneser_ney_against_dictionaries(spark, labelled):
    """Counts, discounts, backoff, shares of the classes and length, word by word in plain Python."""
    docs, labels = labelled
    sample = toxicity.Labels.sample(labels.where("doc_id % 3 <> 1"), "toxic", 1000)
    table = toxicity.word_counts(docs, sample)
    model = toxicity.KneserNey.of(table)
    rows, label = docs.collect(), {r.doc_id: r.toxic for r in labels.where("doc_id % 3 <> 1").collect()}
    plain = plain_evidence([r.text for r in rows], [(r.text, label[r.doc_id]) for r in rows if r.doc_id in label])
    own = np.array([label.get(r.doc_id, -1) for r in rows])
    texts = pa.array([r.text for r in rows], pa.string())
    assert np.allclose(toxicity.Evidence(model).of(texts), [plain(r.text) for r in rows])
    assert np.allclose(toxicity.Evidence(model).of(texts, own), [plain(r.text, label.get(r.doc_id)) for r in rows])
    counts = table.toPandas()
    words = counts[counts["key"] % 4 == 2]
    assert words["n"].sum() == sum(len(set(re.findall("[a-z]+", r.text or ""))) for r in rows)
    # The mass that discounts take is what lower orders hand out: with q for it, each class' shares add up to one.
    for y in (0, 1):
        n, order = words[f"n{y}"].to_numpy(), model.orders[-1]
        assert np.isclose(((n - toxicity.discount(n)) / order.total[y] + order.taken[y] * words["n"] / words["n"].sum()).sum(), 1)


def test_the_corpus_decides_on_rare_words():
    """A word that a class has hardly seen is judged by how common the whole corpus has it."""
    learnt = [(f"bad thing{k}", 1) for k in range(4)] + [(f"good thing{k}", 0) for k in range(4)]
    filler = [f"word{k}" for k in range(50)]
    before = plain_evidence([t for t, _ in learnt] + filler, learnt)
    after = plain_evidence([t for t, _ in learnt] + filler + ["bad"] * 40, learnt)
    assert 0 < after("bad word1 word2") < before("bad word1 word2") / 2


def test_words_of_letters():
    texts = ["Ab, c\u2019d  É\u00a0x 你好 12z", None, "", "…"]
    found = next(toxicity.letters(pa.array(texts, pa.string())))
    raw = found.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(found.start, found.end)] == ["ab", "c", "d", "é", "x", "你", "好", "z"]
    assert list(np.diff(found.bounds)) == [8, 0, 0, 0]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices(["an", "er", "th", "in", "ou", "re"], k=r.randint(1, 4)))
    docs, labels = [], []
    for k in range(240):
        words = [word() for _ in range(r.randint(20, 80))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = "gruz" + word()
        good = k % 3 != 0
        text = " ".join(words if good else [w + "###" for w in words])
        docs.append((k, text, "x"))
        labels.append((k, int(good), int(toxic)))
    docs += [(240, None, "x"), (241, "", "x"), (242, "1 2 3", "x"), (None, "gruzan", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"))
    rows = {r.doc_id: r for r in toxicity.scored_with_folds(docs, toxicity.score(docs, model), 1, 3).collect()}
    assert len(rows) == 244 and all(0 <= r.score <= 1 for r in rows.values())
    right = [(r.predicted == 1) == (k % 4 == 0) for k, r in rows.items() if k is not None and k < 240 and k % 3 == 1]
    assert np.mean(right) > 0.95
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.score < 0.7}


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.fit(docs.limit(0), labels) is None


def test_quality_classifier(spark, labelled):
    docs, labels = labelled
    model = quality_classifier.fit(docs, labels.where("doc_id % 4 <> 2"))
    rows = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    assert len(rows) == 244 and all(0 <= r.score <= 1 for r in rows.values())
    right = [(r.score >= 0.7) == (k % 3 != 0) for k, r in rows.items() if k is not None and k < 240 and k % 4 == 2]
    assert np.mean(right) > 0.95


def test_quality_classifier_against_numpy(spark, labelled):
    """The same fit and scores from one matrix in memory: normal equations, pooled calibration, interpolation."""
    docs, labels = labelled
    learn = labels.where("doc_id % 4 <> 2")
    model = quality_classifier.fit(docs, learn)
    text, y = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in learn.collect()}
    ids = sorted(y)
    calibrates = (_text.mix(np.array(ids, np.uint64) + np.uint64(17)) % np.uint64(4) == 0)
    x = quality_classifier.statistics(pa.array([text[k] for k in ids], pa.string()))
    good = np.array([y[k] for k in ids], float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    rng = np.random.default_rng(7)
    w, phase = rng.normal(0, np.sqrt(2 * 0.06), (x.shape[1], 160)), rng.uniform(0, 2 * np.pi, 160)
    wave = lambda v: np.hstack([np.cos(np.clip((v - mean) / scale, -6, 6) @ w + phase) * np.sqrt(2 / 160), np.ones((len(v), 1))])
    z = wave(x[~calibrates])
    beta = np.linalg.solve(z.T @ z + 1e-3 * len(z) / 160 * np.eye(161), z.T @ good[~calibrates])
    assert np.allclose(model.weights, beta, atol=1e-6)
    raw, cal = wave(x[calibrates]) @ beta, good[calibrates]
    at = np.clip(((raw + 0.5) / 2 * 200).astype(int), 0, 199)
    full = np.unique(at)
    level = [cal[at == b].mean() for b in full]
    size = [(at == b).sum() for b in full]
    fitted = [max(min(np.average(level[i : j + 1], weights=size[i : j + 1]) for j in range(k, len(full))) for i in range(k + 1)) for k in range(len(full))]
    assert np.allclose(model.levels, fitted) and np.allclose(model.edges, -0.5 + (full + 0.5) / 100)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs.where("doc_id is not null"), model).collect()}
    every = sorted(got)
    want = np.interp(wave(quality_classifier.statistics(pa.array([text[k] for k in every], pa.string()))) @ beta, model.edges, fitted)
    assert np.allclose([got[k] for k in every], want, atol=1e-6)


def test_quality_classifier_odd_inputs(spark, labelled):
    docs, labels = labelled
    assert quality_classifier.fit(docs, labels.limit(0)) is None
    assert quality_classifier.score(docs.limit(0), None).collect() == []
    x = quality_classifier.statistics(pa.array([None, "", " ", "a", "b " * 100, "\n\n", "é" * 50]))
    assert np.isfinite(x).all() and not x[:2].any()


def test_isotonic():
    fitted = quality_classifier.isotonic(np.array([1.0, 0, 3, 2, 5]), np.array([2.0, 2, 4, 5, 5]))
    assert (np.diff(fitted) >= 0).all() and fitted[-1] == 1.0
    assert fitted[0] == fitted[1] == 0.25


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = BoostedTrees(n_trees=40, depth=3).fit(x, y)
    z = r.normal(size=(500, 4))
    assert (((z[:, 0] > 0) ^ (z[:, 1] > 0)) == (model.log_odds(z) > 0)).mean() > 0.93


@pytest.fixture(scope="module")
def trees():
    return html_extract.fit()


def test_held_out_pages(trees):
    exact = 0
    for page in html_pages.pages(200, 77):
        nodes, blocks = html_extract.parse(page, html_pages.page_label)
        label = [n.label for n in nodes]
        for k in range(1, len(nodes)):
            label[k] = label[nodes[k].parent] if label[k] < 0 else label[k]
        kept = html_extract.decode(nodes, trees.log_odds(html_extract.features(nodes)))
        exact += [t for k, t in blocks if label[k] == 1] == [t for k, t in blocks if kept[k]]
    assert exact >= 180


def test_extraction(spark, trees):
    article = "<article><h1>A &amp; B</h1><p>One\n two  <b>three</b><br>four.<p>Five &lt;six&gt; seven, and a good many more words to read.</article>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><script>var t='</p>';</script><div class='ad'>Buy now.</div>{article}<!-- x --><footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "just text"), (5, "u", "<p>a<div><"), (6, "u", "<a href=\"x>y</a>" + "<div>" * 3000)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).collect()}
    assert got[1].text == "A & B\nOne two three four.\nFive <six> seven, and a good many more words to read."
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), trees).collect() == []


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>T</title><p>Before<article><header><h1>Top</h1></header><p>Body</article>", ["Before", "Top", "Body"]),
        ("<head><title>T</title></head><header>Top</header>", ["Top"]),
        ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<object data=x><p>Fallback</object><p>End", ["where x=2 holds", "Fallback", "End"]),
        ("<math><mi>x</mi><p>One<object><p>Two", ["x", "One", "Two"]),
        ("<div><svg><path d=x><title>d</title></div><p>One<svg><svg/><svg><text>t</text></svg>u</svg> two", ["One two"]),
        ("<select><option>a<option>b<article><p>One</article><select><option>c</select>", ["One"]),
        ("One<svg>two<select>three", ["Onetwothree"]),
        ("İ" * 40 + "<script>x</script>One<STYLE>y</Style >two<script></scripts></script>", ["İ" * 40 + "Onetwo"]),
        ("<template><p>x<template>y</template>z</template>One<script>never closed", ["One"]),
    ],
)
def test_no_text_is_cut(page, texts):
    assert [t for _, t in html_extract.parse(page)[1]] == texts


def test_decoding_never_keeps_below_a_dropped_node():
    nodes = [html_extract.Node("body", -1, 0)]
    for parent in (0, 1, 1, 0):
        nodes.append(html_extract.Node("div", parent, 1))
    kept = html_extract.decode(nodes, np.array([1.0, -9.0, 2.0, 3.0, -1.0]))
    assert list(kept) == [True, False, False, False, False]
    kept = html_extract.decode(nodes, np.array([1.0, -2.0, 2.0, 3.0, -1.0]))
    assert list(kept) == [True, True, True, True, False]


ARTICLE = "<article><h1>Title of it</h1><p>{}</p><p>Second paragraph, with some more words in it. It goes on for a while.</p></article>"
MENU = "<nav class=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
FOOT = "<footer class=footer><p><a href=/c>Imprint</a> &copy; us</p></footer>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("Plain &amp; simple,\n  two&nbsp;words &#x41;&lt;b&gt;.", "Plain & simple, two words A<b>."),
        ("Odd <b data-y='top'>labels</b> <i data-y>are</i> <u data-y=''>text</u>.", "Odd labels are text."),
        ("\u0130" * 30 + "<script>var x = '</p>';</script> after the script.", "\u0130" * 30 + " after the script."),
        ("With <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object data=a>a fallback</object>.", "With x=1 and a fallback."),
        ("Open <noscript> and <select> and <iframe> do not end it.", "Open and"),
        ("Styles <style>p{}</style>and <textarea>typed</textarea>go, <template><p>so</p></template>too.", "Styles and go, too."),
        ("Attributes <a title='a > b' class=\"x'y\" href=>with</a> signs < 3 & more.", "Attributes with signs < 3 & more."),
        ("<xmp>if (a < b) &amp; <p></xmp>", "if (a < b) &amp; <p>"),
    ],
)
def test_hand_written_pages(trees, inner, text):
    """What is in the article stays, whatever it is made of; what is around it goes."""
    got = html_extract.main_texts(["<html><body>" + MENU + ARTICLE.format(inner) + FOOT + "</body></html>"], trees)[0]
    lines = got.split("\n")
    assert lines[0] == "Title of it" and lines[-1].startswith("Second paragraph")
    assert lines[1].startswith(text) if inner.startswith("Open") else "\n".join(lines[1:-1]) == text
    assert "Home" not in got and "Imprint" not in got


def test_odd_pages(spark, trees):
    """Nulls, empties, repeated rows, pages without markup, long pages, attributes of every kind."""
    long = ARTICLE.format("word " * 200_000)
    found = [None, "", "   ", "<", "<p", "no markup at all", "<p data-y=top>x</p>", "</p></div>", "<!-- open", "<div " * 500, long, long]
    docs = spark.createDataFrame([(k, None, h, "t") for k, h in enumerate(found)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(docs, trees).collect()}
    assert len(got) == len(found) and all(r.n_chars == len(r.text) for r in got.values())
    assert [got[k].text for k in (0, 1, 2)] == ["", "", ""] and got[5].text in ("", "no markup at all")
    assert got[10].text == got[11].text and got[10].n_chars > 900_000
