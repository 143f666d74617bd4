import hashlib
import math
import random
import re
import struct
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from twinlens.llm import bpe, mixing, quality_rules
from twinlens.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = defaultdict(list)
    for i in range(n - 7):
        windows[tuple(words[i : i + 8])].append(i)
    hit = set()
    for at in windows.values():
        if len(at) > 1:
            hit.update(j for i in at for j in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_columns(make, texts):
    texts = [*texts, "#*$ %&|<> x", "a b c d e f g h\n" * 9, "one line\n" * 3 + "\n\n \n"]
    for r in quality_rules.judge(make(texts)).collect():
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_divergence_rejects_junk_only(spark):
    r = random.Random(3)
    common = ["the", "of", "and", "to", "in", "is", "that", "for"]
    word = lambda: r.choice(common) if r.random() < 0.5 else "".join(r.choices(["an", "er", "th", "ou"], k=3))
    texts = [" ".join(word() for _ in range(100)) for _ in range(120)]
    texts += [t.upper().replace(" ", "!! ") for t in texts[:5]] + [t.replace(" ", "### ") for t in texts[5:10]] + ["short text"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert all(kept[k] for k in range(120)) and not any(kept[k] for k in range(120, 131))
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_small_languages_have_references_of_their_own(spark):
    r = random.Random(6)
    latin, cyrillic = "et in non ad cum sed per pro".split(), "и в не на что с по как".split()
    text = lambda common, parts, n: " ".join(r.choice(common) if r.random() < 0.5 else "".join(r.choices(parts, k=3)) for _ in range(n))
    small = [(k, text(latin, ["us", "um", "ae"], 100), "la") for k in range(2)] + [(2 + k, text(cyrillic, ["ть", "ов", "ен"], 100), "ru") for k in range(2)]
    large = [(10 + k, text(["the", "of", "and", "to"], ["an", "er", "th", "ou"], 11000), "en") for k in range(20)]
    judged = lambda rows: {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    alone, beside = judged(small), judged(small + large)
    assert all(beside[k].kept for k in range(4))
    assert all(beside[k] == alone[k] for k in range(4))


def test_js_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt((kl(p, m) + kl(q, m)) / 2)
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality_rules.js_distance(F.col("p"), F.col("q")).alias("d"), quality_rules.js_distance(F.col("p"), F.col("p")).alias("z")).first()
    assert abs(row.d - want) < 1e-9 and row.z == 0


@pytest.fixture(scope="module")
def model():
    return bpe.load(vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_like_the_library(model, library, texts):
    r = random.Random(4)
    odd = ["a", "B", "İ", "Σ", "é", "\x1c", "\x85", " ", "　", "ﬁ", "ß", "1", "²", "'S", "'re", "!?", "\U0001f600", "<|endoftext|>", "<|startoftext|>", " ", "\n", "中", "한", "\0", "​", "the"]
    for text in [*(t or "" for t in texts), *("".join(r.choices(odd, k=r.randint(0, 25))) for _ in range(1500))]:
        ids = library.encode(text, add_special_tokens=False).ids
        packed, decoded = model.packed(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids == model.encode(text)
        assert decoded == library.decode(ids, skip_special_tokens=False) == model.decode(ids)


def test_long_words_like_the_library(model, library, monkeypatch):
    """Words beyond the scanned length, runs of one letter among them, and both ways of merging on short ones."""
    r = random.Random(9)
    long = ["a" * 5000, "ab" * 3000, "".join(r.choices("etaoinshr", k=20_000)), "x" * 65, "é" * 700, "é中" * 900, "zqj" * 200 + "ing"]
    short = ["".join(r.choices("aet nisor", k=r.randint(1, 30))) for _ in range(400)]
    for text in long:
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "SCANNED", 1)
    fresh = bpe.ForcedBpe(vocabulary())
    for text in short:
        assert fresh.encode(text) == library.encode(text, add_special_tokens=False).ids
    began = time.perf_counter()
    assert model.packed("".join(r.choices("etaoinshrdlu", k=1_000_000)))[0]
    assert time.perf_counter() - began < 30
    assert max(map(len, model.seen)) <= bpe.LONGEST


def test_cuts_are_forced(model):
    for word in ("internationalization", "zqxjk", "thethethe"):
        parts = model.fragments("".join(bpe.byte_alphabet()[b] for b in word.encode()))
        assert "".join(parts) == word
        for a, b in zip(parts, parts[1:]):
            assert not any(a[-1] + b[0] in t for t in model.vocab)


def test_encoded_documents(make, library, texts):
    got = {r.doc_id: r for r in bpe.encoded_digests(make(texts), vocabulary()).collect()}
    whole = {r.doc_id: r for r in bpe.encode_documents(make(texts), vocabulary()).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(whole[k].ids) == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded_digests(make([]), vocabulary()).collect() == []


def test_fill_gives_shortages_to_siblings():
    assert mixing.fill(90, [(1, 10), (1, 100), (1, 100)]) == [10, 40, 40]
    assert mixing.fill(90, [(2, 100), (1, 100), (0, 100)]) == [60, 30, 0]
    assert mixing.fill(500, [(1, 10), (1, 20)]) == [10, 20]


def test_budgets_go_to_siblings_before_ancestors():
    leaves = {("a", "x", "1"): 10.0, ("a", "x", "2"): 100.0, ("a", "y", "1"): 100.0, ("b", "x", "1"): 1000.0}
    got = mixing.budgets(leaves, mixing.Plan(max_epochs=1), 200.0)
    # a and b get 100 each; in a, x and y get 50 each; in x the short leaf leaves 15 to its sibling.
    assert got == {("a", "x", "1"): 10.0, ("a", "x", "2"): 40.0, ("a", "y", "1"): 50.0, ("b", "x", "1"): 100.0}


def chained_hash(*values):
    """Spark's xxhash64 of several values: each is hashed with the hash before it as the seed; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v)
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_fill(budget, children):
    """Water level by bisection: child k gets min(supply, weight * level)."""
    if sum(s for w, s in children if w > 0) <= budget:
        return [s if w > 0 else 0.0 for w, s in children]
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(s, w * mid) for w, s in children) < budget:
            low = mid
        else:
            high = mid
    return [min(s, w * low) for w, s in children]


def mixture_expected(rows, plan):
    """rows: (doc_id, text, lang, source), repeated and null ids included; a row is known by its place in the list."""
    leaf = defaultdict(list)
    for k, (doc, text, lang, source) in enumerate(rows):
        digits = re.search(r"([0-9]{1,9})$", source or "")
        path = (f"domain{int(digits[1]) % 4 if digits else 0}", lang or "", source or "")
        leaf[path].append((k, len(WORD.findall(text or "")), doc, chained_hash(doc, text)))
    weight = lambda path: plan.weights.get(path, 1.0)
    allowed = {p: all(weight(p[:k]) > 0 for k in (1, 2, 3)) for p in leaf}
    supply = lambda prefix: sum(n * plan.max_epochs for p, found in leaf.items() if p[: len(prefix)] == prefix and allowed[p] for _, n, *_ in found)
    budget = {(): min(plan.share * sum(n for found in leaf.values() for _, n, *_ in found), supply(()))}
    for depth in range(3):
        for node in {p[:depth] for p in leaf}:
            children = sorted({p[: depth + 1] for p in leaf if p[:depth] == node})
            budget |= dict(zip(children, plain_fill(budget[node], [(weight(c), supply(c)) for c in children])))
    out = Counter()
    for p, found in leaf.items():
        total, left = sum(n for _, n, *_ in found), budget[p]
        if not allowed[p] or not total:
            continue
        for e in range(plan.max_epochs):
            at, taken = 0, {}
            for o, n, k in sorted((chained_hash(np.int32(plan.seed), np.int32(e), doc, row), n, k) for k, n, doc, row in found):
                taken.setdefault(o, left >= total * (1 - 1e-9) or at < left - 1e-6 * total)
                if taken[o]:
                    out[k, e] += 1
                at += n
            left -= total
    return out


@pytest.mark.parametrize("plan", [mixing.Plan(share=0.5), mixing.Plan(share=1.5, max_epochs=3, weights={("domain1",): 3.0, ("domain2", "en"): 0.0}), mixing.Plan(share=9.0, max_epochs=2)])
@pytest.mark.parametrize("odd", [False, True])
def test_mixture(spark, make, texts, plan, odd):
    """Against plain Python; odd: ids that repeat or are null, equal rows, and columns of every name that the operator uses."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in make(texts).collect()]
    if odd:
        rows = [(None if k % 7 == 0 else 5 if k % 3 else k, *r[1:]) for k, r in enumerate(rows)] + rows[8:12] * 2
    names = "__path __tokens __times __epoch times epoch path tokens row all whole cut".split()
    docs = spark.createDataFrame([(*r, k, *["x"] * len(names)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in names))
    chosen = mixing.select_mixture(docs, plan)
    assert chosen.columns == [*docs.columns, *mixing.added_names(docs)]
    got = Counter((r.n_chars, r[mixing.added_names(docs)[2]]) for r in chosen.collect())
    assert got == mixture_expected(rows, plan)
    taken, whole = (sum(n * len(WORD.findall(rows[k][1] or "")) for (k, _), n in x.items()) for x in (got, Counter((k, 0) for k in range(len(rows)))))
    if plan.share == 0.5 and not odd:
        assert 0.5 * whole <= taken + 1e-6 and taken <= 0.5 * whole + 20 * 9000


def test_mixture_is_seeded_and_handles_empty(make, texts):
    docs = make(texts)
    pick = lambda seed: sorted(r.doc_id for r in mixing.select_mixture(docs, mixing.Plan(seed=seed)).collect())
    assert pick(1) == pick(1) != pick(2)
    assert mixing.select_mixture(make([])).collect() == []
