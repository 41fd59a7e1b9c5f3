"""Top-k search, phrases and whitening: brute force, dense tiles, cut texts, close eigenvalues, odd rows, empty tables."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import collocations as phrases, topk_search, whitening
from riskframe.llm.vectors import products

NAN, INF = float("nan"), float("inf")
VECTORS = [
    (0, [0.5, -0.25, 0.125]), (50, [0.5, -0.25, 0.125]), (50, [1.0, 1.0, 1.0]), (7, [0.5, -0.25, 0.125]), (8, None), (9, [0.1, None, 0.2]),
    (10, [NAN, 0.0, 1.0]), (11, [INF, 0.0, 1.0]), (None, [0.5, -0.25, 0.125]), (100, []), (12, [0.5]), (13, [-0.001, 0.001, 0.0]), (14, [0.0, 0.0, 0.0]),
]


@pytest.fixture(scope="module")
def vectors(llm):
    frame = llm.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    for name in ("row", "x", "score", "rank", "id", "n", "q", "cluster", "component", "at"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame


def integers(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    return [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (d - len(v))) for i, v in good]


def plain_top(rows, k, is_query):
    x, out = integers(rows), collections.Counter()
    for at, (i, v) in enumerate(x):
        if i is None or not is_query(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, n, j) for n, (j, w) in enumerate(x) if n != at)
        for rank, (s, _, _, _, j) in enumerate(scores[:k], 1):
            out[(i, rank, j, -s)] += 1
    return out


def top_rows(frame):
    return collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in frame.collect())


def test_top_k_of_odd_vectors(vectors):
    got = top_rows(topk_search.top_k(vectors, F.col("vec_id") % 50 == 0))
    assert got == plain_top(VECTORS, 5, lambda i: i % 50 == 0)
    assert topk_search.top_k(vectors.filter("false"), F.lit(True)).count() == 0
    assert topk_search.top_k(vectors, F.lit(None).cast("boolean")).count() == 0
    assert topk_search.top_k(vectors.filter("vec_id = 7"), F.lit(True)).count() == 0


def test_top_k_of_many_blocks_by_brute_force(llm):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    x = centres[draw.integers(0, 12, 6000)] + 0.1 * draw.normal(size=(6000, 16))
    x[:2500] = x[0]  # one group of equal vectors, more than a third of all
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    got = top_rows(topk_search.top_k(llm.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7), F.col("vec_id") % 97 == 0, 9))
    whole = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 6000, 97):
        s = whole @ whole[q]
        s[q] = -(1 << 60)
        best = np.lexsort((np.arange(6000), -s))[:9]
        assert all(got[(q, r, int(j), int(s[j]))] == 1 for r, j in enumerate(best, 1))
    assert sum(got.values()) == 9 * len(range(0, 6000, 97))


def test_bounds_hold_and_blocks_are_left_out():
    draw = np.random.default_rng(6)
    centres = 100 * draw.normal(size=(40, 8))
    held, high, low = [], [], []
    for c in range(40):
        x = np.floor(centres[c] + draw.normal(size=(30, 8))).astype(np.int64)
        row = np.arange(c * 30, c * 30 + 30)
        held.append(topk_search.Block(row, row, row * 2, x)), high.append(x.max(axis=0)), low.append(x.min(axis=0))
    high, low, everything = np.array(high), np.array(low), np.vstack([b.x for b in held])
    queries, own = everything[::100], np.arange(1200)[::100]
    bound = topk_search.bounds(queries, high, low)
    assert all((bound[:, b] >= products(queries, held[b].x).max(axis=1)).all() for b in range(40))
    scored, plain = [], topk_search._score
    topk_search._score = lambda tops, who, *rest: (scored.append(len(who)), plain(tops, who, *rest))
    try:
        tops = topk_search.Tops(3, np.full(len(own), topk_search.LOWEST))
        topk_search.search(tops, queries, own, held, high, low)
    finally:
        topk_search._score = plain
    assert sum(scored) < 0.4 * 40 * len(own)
    q, s, i, _ = tops.found
    for n, row in enumerate(own):
        all_ = products(queries[n:n + 1], everything)[0]
        all_[row] = -(1 << 60)
        want = np.lexsort((np.arange(1200), -all_))[:3]
        assert i[q == n].tolist() == want.tolist() and s[q == n].tolist() == all_[want].tolist()


def test_products_past_doubles():
    x = np.array([[1 << 40, 3], [(1 << 31) - 1, -5]])
    assert products(x[1:], x[1:])[0, 0] == ((1 << 31) - 1) ** 2 + 25
    assert products(x[:1], x[:1])[0, 0] == (1 << 63) - 1  # past the long range: its end


def plain_phrases(rows, least, longest=5, first=2000):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        data = (text or "").encode().lower()
        for c in b".,;:!?\n\x0b\x0c\r":
            data = data.replace(bytes([c]), b"\n")
        for piece in data.split(b"\n"):
            w = [x for x in piece.replace(b"\t", b" ").split(b" ") if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if any(l2 == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for (l2, q), b in cand.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, b" ".join(p), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, ps in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(ps)[:first], 1))


def phrase_rows(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(n, seed):
    draw = random.Random(seed)
    words = ["Ä", "été", "bB", "c", "d", "E", "f#", "日本", "g\x1ch", " i"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "]
    for _ in range(n):
        text = "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(60)))
        yield draw.choice(["x", "y", None, "und", ""]), draw.choice([text, text, "a b c d e f " * 3, None, "", "..."])


@pytest.mark.parametrize("tokens, slab, ranks", [(120_000, 1 << 20, 10), (120_000, 1 << 20, 10**6), (50, 16, 10**6)])
def test_phrases_by_brute_force(llm, monkeypatch, tokens, slab, ranks):
    monkeypatch.setattr(phrases, "RANKS", ranks)  # more symbols than that are joined to the chunks
    rows = list(corpus(300, 1))
    frame = llm.createDataFrame(rows, "lang string, text string").repartition(3)
    assert phrase_rows(phrases.collocations(frame, least=6, tokens=tokens, slab=slab)) == plain_phrases(rows, 6)


@pytest.mark.parametrize("ranks", [0, 10**6])
def test_a_long_text_is_cut_without_loss(llm, monkeypatch, ranks):
    monkeypatch.setattr(phrases, "RANKS", ranks)
    draw = random.Random(2)
    text = " ".join(draw.choice("abcde") for _ in range(5000))
    rows = [("x", text), ("x", "a b c"), ("x", "aaa " * 700)]
    frame = llm.createDataFrame(rows, "lang string, text string")
    assert phrase_rows(phrases.collocations(frame, least=5, tokens=40, slab=30)) == plain_phrases(rows, 5)
    if ranks:
        assert phrase_rows(phrases.collocations(frame, least=5, longest=2, first=7, tokens=100)) == plain_phrases(rows, 5, 2, 7)


def test_phrases_of_odd_rows(llm, odd, none):
    got = phrases.collocations(odd.withColumn("lang", F.lit(None)), least=100)
    assert {r.lang for r in got.collect()} == {"und"} and phrases.collocations(none, "source", "text").count() == 0
    assert phrases.collocations(odd.filter("text is null"), "source").count() == 0
    assert phrases.collocations(odd, "source", least=10**9).count() == 0


def test_tiles_count_dense_and_sparse_pairs():
    draw = np.random.default_rng(3)
    a = np.r_[draw.integers(0, 900, 60_000), draw.integers(0, 100_000, 5000), np.full(20_000, 2**31 - 1)]
    b = np.r_[draw.integers(0, 900, 60_000), draw.integers(0, 100_000, 5000), np.full(20_000, 2**31 - 1)]
    codes, counts = phrases.tiled(a, b)
    want = collections.Counter(((a << 32) | b).tolist())
    assert len(codes) == len(set(codes.tolist())) and dict(zip(codes.tolist(), counts.tolist())) == want
    assert len(phrases.tiled(a[:0], b[:0])[0]) == 0


def test_scores_past_64_bits(llm):
    one = llm.createDataFrame([(10**12, 4 * 10**17, [2 * 10**12, 10**12], [3 * 10**12, 10**12])], "a long, n long, starts array<long>, ends array<long>")
    best = phrases.scored(one).first().best
    cuts = [(1000 * 10**12 * 4 * 10**17 // (l * r), k) for k, l, r in [(1, 2 * 10**12, 10**12), (2, 10**12, 3 * 10**12)]]
    assert (best.score, best.k) == min(cuts)


def whole(rows):
    return np.array([v for _, v in integers(rows)], float)


def test_whitening_by_brute_force(llm, data):
    table = llm.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    x = whole(rows)
    points = np.unique(x, axis=0)
    n, s = len(points), points.sum(axis=0)
    v = (points - s / n).T @ (points - s / n) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    got = whitening.whitened(table.union(table.limit(20))).collect()  # repeated rows count once in the fit and are returned each
    assert len(got) == 4 * (len(rows) + 20)
    at = {i: k for k, (i, _) in enumerate(rows)}
    want = ((x - s / n) @ q[:, :4]) / np.sqrt(e[:4])
    sign = {}
    for r in got:
        w, k = want[at[r.vec_id]], r.component - 1
        sign.setdefault(k, 1 if w[k] * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(sign[k] * w[k], abs=1e-9)
        assert r.n == n and r.deviation == int(((n * x[at[r.vec_id]] - s) ** 2).sum())
        assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-10) and r.identity_error < 1e-9


def test_whitening_of_odd_vectors(vectors):
    rows = whitening.whitened(vectors).collect()
    x = whole(VECTORS)
    points = np.unique(x, axis=0)
    assert len(rows) == 3 * len(x) and {r.component for r in rows} == {1, 2, 3} and {r.n for r in rows} == {len(points)}
    assert whitening.whitened(vectors.filter("false")).count() == 0 and whitening.whitened(vectors.filter("vec_id = 8")).count() == 0
    assert whitening.whitened(vectors.filter("vec_id = 100")).count() == 0  # no dimension, no component
    same = whitening.whitened(vectors.filter("vec_id = 7")).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in same] == [(0.0, 0.0, 1.0, 0)] * 3


def test_deviation_past_long():
    assert whitening._deviations(np.array([[1 << 40]]), 1 << 10, [0]) == [None]
    assert whitening._deviations(np.array([[3_000_000_000]]), 1, [0]) == [9 * 10**18]


@pytest.mark.parametrize("values", [
    np.linspace(100, 1, 40), [100, 99.9999999, 99.99999, 50, *np.linspace(1, 2, 36)], [7.0] * 40, [9.0, 9.0, 9.0 + 1e-12, *[0.0] * 37],
    [1e12, 1.0, 1e-3, *[1e-6] * 37], [5 + 1e-7 * k for k in range(20)] + [4.9999 - 1e-9 * k for k in range(20)], [3.0],
])
def test_eigenvectors_of_close_eigenvalues(values):
    values = np.array(values)
    q, _ = np.linalg.qr(np.random.default_rng(9).normal(size=(len(values), len(values))))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigen(a)
    top = np.abs(values).max()
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    assert np.abs(a @ x - x * e).max() < 2e-15 * top * 4 and np.abs(e - np.sort(values)[::-1]).max() < 2e-15 * top * 4
