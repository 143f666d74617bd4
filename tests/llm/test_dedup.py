import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlens.llm import _text, exact_dedup, jaccard_join, line_dedup, substring_dedup
from twinlens.llm._graph import components
from twinlens.llm._store import Scratch
from twinlens.llm.fm_index import FmIndex, WaveletMatrix, suffix_order

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def as_dict(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def exact_expected(texts):
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[SPACE.sub("", t or "")].append(k)
    out = {}
    for norm, ids in groups.items():
        keep = min(ids, key=lambda k: (-len(texts[k] or ""), k))
        for k in ids:
            out[k] = (keep, len(ids), k == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact_dedup(make, texts):
    assert as_dict(exact_dedup.duplicate_groups(make(texts))) == exact_expected(texts)


def test_exact_dedup_keeps_columns_and_empty_tables(make, texts):
    docs = make(texts)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in exact_expected(texts).items() if v[2]}
    assert exact_dedup.duplicate_groups(make([])).collect() == []


def test_chunks_rebuild_the_text(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    values = ["", "a", "z" * 10_000, "".join(r.choices("abcdeilmnorsté\U0001f600", k=20_000))]
    df = spark.createDataFrame([(v,) for v in values], "t string").select("t", exact_dedup.chunked(F.col("t")).alias("c"))
    for row in df.collect():
        assert "".join(row.c) == row.t
        assert all(len(c) <= exact_dedup.MAX_CHUNK for c in row.c)


@pytest.mark.parametrize("kinds", [1, 256])
def test_chunk_identifiers_are_verified(make, monkeypatch, texts, kinds):
    """Identifiers cut to a few values collide everywhere; ranks keep the chunks apart."""
    real = exact_dedup._identifier
    monkeypatch.setattr(exact_dedup, "_identifier", lambda c: F.struct(F.pmod(real(c)["a"], F.lit(kinds)).alias("a"), F.lit(0).alias("b")))
    docs = make(texts)
    assert not exact_dedup.shared_identifiers(docs.select("doc_id", "text")).isEmpty()
    assert as_dict(exact_dedup.duplicate_groups(docs)) == exact_expected(texts)


def test_exact_dedup_of_repeated_and_null_ids(spark, texts):
    """Every row is a document of its own; one row of each group stays."""
    ids = [None if k % 5 == 0 else k % 17 for k in range(len(texts))]
    rows = [(i, t, 1, "a") for i, t in zip(ids, texts)] + [(2, texts[9], 2, "b")] * 3 + [(None, "lone", 3, "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int, row string")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    got = exact_dedup.duplicate_groups(docs).collect()
    want = Counter((i, min(groups[n])[3], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, n in ((i, SPACE.sub("", t or "")) for i, t, *_ in rows))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(n.encode()).hexdigest() for n in groups)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(SPACE.sub("", r.text or "") for r in kept.collect()) == Counter(list(groups))


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(make, texts, batches):
    got = as_dict(line_dedup.kept_sha256(line_dedup.dedup_lines(make(texts), batches=batches)))
    assert got == line_dedup.brute_force(list(enumerate(texts)))
    assert sum(v[1] for v in got.values()) >= 29


def test_line_dedup_of_repeated_and_null_ids(spark, texts):
    """Rows of one id are documents of their own; those equal in id and text are one."""
    ids = [None if k % 6 == 0 else k % 11 for k in range(len(texts))]
    rows = [(i, t, 1) for i, t in zip(ids, texts)] + [(3, texts[60], 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int")
    keys = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).distinct().collect()
    order = sorted(keys, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.row))
    want = line_dedup.brute_force([(k, r.text) for k, r in enumerate(order)])
    of = {(r.doc_id, r.text): want[k] for k, r in enumerate(order)}
    got = Counter(tuple(r) for r in line_dedup.kept_sha256(line_dedup.dedup_lines(docs)).collect())
    assert got == Counter((r[0], *of[r[0], r[1]]) for r in rows)


def test_line_runs_merge_without_shuffles(spark):
    """Batches give their fresh keys; levels hold one run for each bit of the number of batches; runs are merged as they lie."""
    index, seen, held = line_dedup.LineRuns(spark), set(), Counter()
    r = random.Random(4)
    for b in range(5):
        rows = {(r.randrange(40), 7, 1000 - 100 * b - r.randrange(100)) for _ in range(60)}
        fresh = index.add(spark.createDataFrame(sorted(rows), "k1 long, k2 long, doc long"))
        last = {k: max(d for x, _, d in rows if x == k) for k in {x for x, *_ in rows}}
        assert {(x.k1, x.last_doc) for x in fresh.collect()} == {(k, d) for k, d in last.items() if k not in seen}
        seen |= set(last)
        held.update(k for k, *_ in rows)
        assert sum(2**level * len(runs) for level, runs in enumerate(index.levels)) == b + 1
    plan = index.merged(*index.runs()[:2])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert {x.k1 for x in index.condemned().collect()} == {k for k, n in held.items() if n >= 3}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_line_dedup_empty(make):
    assert line_dedup.dedup_lines(make([])).collect() == []


def test_substring_dedup(make, texts):
    got = as_dict(substring_dedup.kept_sha256(substring_dedup.dedup_substrings(make(texts))))
    assert got == substring_dedup.brute_force(list(enumerate(texts)))
    assert sum(v[1] for v in got.values()) > 1000


def test_substring_dedup_splits_hot_anchors(make, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SNIPPETS", 2)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    got = as_dict(substring_dedup.kept_sha256(substring_dedup.dedup_substrings(make(texts))))
    assert got == substring_dedup.brute_force(list(enumerate(texts)))


def test_substring_dedup_of_repeated_and_null_ids(spark, texts):
    """Rows of one id are documents of their own; those equal in id and text are one."""
    ids = [None if k % 6 == 0 else k % 11 for k in range(len(texts))]
    rows = [(i, t, "x", 1) for i, t in zip(ids, texts)] + [(3, texts[8], "y", 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, doc int")
    keys = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).distinct().collect()
    order = sorted(keys, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.row))
    want = substring_dedup.brute_force([(k, r.text) for k, r in enumerate(order)])
    of = {(r.doc_id, r.text): want[k] for k, r in enumerate(order)}
    got = Counter(tuple(r) for r in substring_dedup.kept_sha256(substring_dedup.dedup_substrings(docs)).collect())
    assert got == Counter((r[0], *of[r[0], r[1]]) for r in rows)


def test_substring_dedup_with_few_anchors(make, texts, monkeypatch):
    """Anchors cut to eight bits only make larger groups."""
    real = substring_dedup._runs
    monkeypatch.setattr(substring_dedup, "_runs", lambda found: None if (r := real(found)) is None else (*r[:3], r[3] & np.uint64(255), r[4]))
    got = as_dict(substring_dedup.kept_sha256(substring_dedup.dedup_substrings(make(texts))))
    assert got == substring_dedup.brute_force(list(enumerate(texts)))


def test_substring_dedup_empty(make):
    assert substring_dedup.dedup_substrings(make([])).collect() == []
    assert as_dict(substring_dedup.dedup_substrings(make([None, "a b"]))) == {0: (0, 0, ""), 1: (2, 0, "a b")}


def test_fm_index_against_scanning():
    """Matching statistics and located places against scans of the text."""
    r = np.random.default_rng(3)
    text = r.integers(1, 5, 400)
    text[[0, 50, 130, 399]] = 0
    index = FmIndex(text)
    circle = np.concatenate([text, text])
    assert [tuple(circle[i : i + 400]) for i in suffix_order(text)] == sorted(tuple(circle[i : i + 400]) for i in range(400))
    ends = np.arange(1, 400)
    length, low, high = index.matching_statistics(text, ends, 8)
    held = {n: Counter(tuple(text[i : i + n]) for i in range(401 - n)) for n in range(1, 9)}
    for end, n, a, b in zip(ends, length, low, high):
        good = [k for k in range(1, min(8, end) + 1) if 0 not in text[end - k : end] and held[k][tuple(text[end - k : end])] > 1]
        assert n == max(good, default=0)
        if n:
            assert sorted(index.places(np.arange(a, b))) == [i for i in range(401 - n) if (text[i : i + n] == text[end - n : end]).all()]
    some = np.flatnonzero(length)
    first = index.first_places(low[some], high[some], block=7)
    assert list(first) == [min(index.places(np.arange(low[k], high[k]))) for k in some]


def test_wavelet_rank():
    r = np.random.default_rng(4)
    s = r.integers(0, 37, 1000)
    w = WaveletMatrix(s, 37)
    for c in range(37):
        at = np.arange(0, 1001, 13)
        assert list(w.rank(np.full(len(at), c), at)) == [int((s[:i] == c).sum()) for i in at]


def test_words_and_hashes():
    values = [None, "", " a\tb\x0bc ", "Été  x", "A b", "a b"]
    found = [w for w in _text.words(pa.array(values), fold=True)]
    assert len(found) == 1
    n = np.diff(found[0].bounds)
    assert list(n) == [0, 0, 3, 2, 2, 2]
    h = found[0].hash
    assert list(h[found[0].bounds[4] : found[0].bounds[5]]) == list(h[found[0].bounds[5] : found[0].bounds[6]])
    assert len(set(h.tolist())) == 5


def shingles(text):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = [x for x in SPACE.split((text or "").translate(fold)) if x]
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_expected(texts, percent=80):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {k: (len(sets[k]), root(k)) for k in range(len(texts))}


def test_jaccard_join(make, texts):
    want = near_expected(texts)
    assert as_dict(jaccard_join.near_duplicates(make(texts))) == want
    assert sum(v[1] != k for k, v in want.items()) > 20


def test_jaccard_join_of_chains_and_edges(make):
    """Chains of documents each 80 % like the next, exact threshold cases, and sub-tiles."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    values = []
    for k in range(30):
        values.append(" ".join(words[k * 3 : k * 3 + 60]))
    for k in range(40):
        start = r.randrange(300)
        values.append(" ".join(words[start : start + r.randint(4, 80)]))
    r.shuffle(values)
    assert as_dict(jaccard_join.near_duplicates(make(values))) == near_expected(values)


@pytest.mark.parametrize(("rows", "size"), [(3, 1 << 20), (1000, 200)])
def test_jaccard_join_with_small_tiles(make, texts, monkeypatch, rows, size):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", rows)
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", size)
    monkeypatch.setattr(jaccard_join, "PAIRS", 50)
    assert as_dict(jaccard_join.near_duplicates(make(texts))) == near_expected(texts)


def test_jaccard_join_of_repeated_and_null_ids(spark, texts):
    """Every row is a document of its own; a component has its least id, nulls last."""
    ids = [None if k % 5 == 0 else k % 17 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, row long")
    component = {k: v for k, v in near_expected(texts).items()}
    names = {}
    for k, (_, c) in component.items():
        names.setdefault(c, []).append(ids[k])
    want = Counter((ids[k], n, min((x for x in names[c] if x is not None), default=None)) for k, (n, c) in component.items())
    assert Counter(map(tuple, jaccard_join.near_duplicates(docs).collect())) == want
    kept = jaccard_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(got.values()) == len(names)  # one of each component, all that link with nothing
    for c, members in names.items():
        assert any((i, t) in got for i, t in zip(ids, texts) if component[texts.index(t)][1] == c or t is None)


def test_jaccard_all_links(make, texts):
    members, links = jaccard_join.all_links(make(texts))
    of = {}
    for r in sorted(members.where("class_id is not null").collect()):
        of.setdefault(r.class_id, r.doc_id)
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    want = {(i, j) for i in of.values() for j in of.values() if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {tuple(sorted((of[r.a], of[r.b]))) for r in links.collect()} == want
    assert links.count() == len(want) > 50


def test_jaccard_representatives_and_empty(make, texts):
    docs = make(texts)
    kept = jaccard_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in near_expected(texts).items() if v[1] == k)
    assert jaccard_join.near_duplicates(make([])).collect() == []


def test_bitmaps_bound_the_overlap():
    """No pair that links is refused, in whatever order and widths; the bound is the one that bit by bit counting gives."""
    r = np.random.default_rng(6)
    for _ in range(30):
        base = np.unique(r.integers(0, 1 << 62, 300).astype(np.uint64))
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(3, len(base)), replace=False), r.integers(0, 1 << 62, r.integers(1, 30)).astype(np.uint64)])) for _ in range(10)]
        sets += [np.unique(np.concatenate([base, r.integers(0, 1 << 62, k).astype(np.uint64)])) for k in (1, 20, 60)]
        n = np.array([len(s) for s in sets])
        column = pa.chunked_array([pa.array([jaccard_join.bitmap(s, jaccard_join.bitmap_bits(len(s))).tobytes() for s in sets], pa.binary())])
        i, j = (np.array(v) for v in zip(*[(i, j) for i in range(len(n)) for j in range(i) if 10 * min(n[i], n[j]) >= 8 * max(n[i], n[j])]))
        for x, y, bound in zip(i, j, jaccard_join.Signatures(column, n).may_link(i, j, 80)):
            bits = min(jaccard_join.bitmap_bits(n[x]), jaccard_join.bitmap_bits(n[y]))
            p, q = (set((_text.mix(sets[k]) % np.uint64(bits)).tolist()) for k in (x, y))
            both = len(np.intersect1d(sets[x], sets[y]))
            most = min(n[x] - len(p - q), n[y] - len(q - p))
            assert both == jaccard_join.overlap(sets[x], sets[y]) <= most
            assert bound == (most if 180 * most >= 80 * (n[x] + n[y]) else -1)
            assert bound >= 0 or 100 * both < 80 * (n[x] + n[y] - both)


def test_pair_blocks_give_each_pair_once(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS", 700)
    first, end = np.array([0, 1, 3, 303, 310]), 400
    got = [(int(a), int(b)) for i, j in jaccard_join.pair_blocks(first, end) for a, b in zip(i, j)]
    want = {(a, b) for x, y in zip(first, [*first[1:], end]) for a in range(x, y) for b in range(a + 1, y)}
    assert len(got) == len(want) and set(got) == want


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {v: root(v) for v in list(up)}
