"""Near-duplicate groups, pieces and the pipeline: brute force, the model's own encoder, odd rows, empty tables."""

import cProfile
import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import near_dedup, pieces


def plain_groups(texts):
    """Smallest id of every group and the set sizes, from all overlapping pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in holders[x] if j < i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def edited(words, draw, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return words


def planted():
    """Copies, near copies at several distances, a chain, a group around a centre, and texts that share a passage."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    texts, passage = [], [word() for _ in range(60)]
    for group in range(12):
        base = [word() for _ in range(draw.randint(30, 400))]
        texts += [" ".join(edited(base, draw, max(1, k * len(base) // 150))) for k in range(6)]
        texts += [" ".join(base).upper(), "  ".join(base) + "\n"]
    base = [word() for _ in range(200)]
    texts += [" ".join(edited(base, draw, 4)) for _ in range(40)]
    link = [word() for _ in range(200)]
    for _ in range(15):
        texts.append(" ".join(link))
        link = edited(link, draw, 3)
    texts += [" ".join([word() for _ in range(60)] + passage) for _ in range(30)]
    draw.shuffle(texts)
    return {i * 3 + 1: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("kind", ["documents", "planted"])
def test_groups_by_all_pairs(llm, texts, kind):
    given = texts if kind == "documents" else planted()
    frame = llm.createDataFrame(list(given.items()), "doc_id long, text string").repartition(4)
    root, sizes = plain_groups(given)
    rows = near_dedup.near_duplicates(frame).collect()
    assert {r.doc_id: r.component_id for r in rows} == root
    assert {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_groups_of_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_dedup.near_duplicates(none).count() == 0
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == [(0, 1, True)] and by_id[2] == [(0, 2, True)] and by_id[3] == [(0, 3, True)]
    assert by_id[4] == [(1, 4, True)] * 2 and by_id[5] == [(1, 4, False)]
    assert by_id[6] == [(10, 6, True)] and by_id[7] == [(10, 6, False)]
    assert by_id[None][0][1:] == (None, True)


def some_words(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def test_texts_under_one_id_are_linked_and_none_is_lost(llm, data):
    a, b, c = (some_words(x) for x in "abc")
    rows = [(3, b), (5, a), (5, b), (8, c), (9, c + " end"), (9, some_words("d")), (9, some_words("d")), (None, b), (None, some_words("e"))]
    frame = llm.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame).filter("doc_id is not null").collect()}
    assert got == {(3, 3, True), (5, 3, False), (8, 8, True), (9, 8, False)}
    kept = corpus_pipeline.one_of_each_group(llm, frame, data).collect()
    assert len(kept) == 5 and len({r.text for r in kept} & {c, c + " end"}) == 1
    assert {(r.doc_id, r.text) for r in kept} >= {(3, b), (5, a), (9, some_words("d")), (None, some_words("e"))}


def test_components_of_paths_and_stars(llm):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(59, 3), (200, 200)]
    got = {r.c: r.root for r in near_dedup.components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k >= 100} == {100} and {v for k, v in got.items() if k < 60} == {3}
    assert near_dedup.components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_band_recall_at_the_threshold():
    """Pairs of sets at 0.75 meet in a band; the estimate stays within its slack."""
    draw = np.random.default_rng(5)
    a, b = near_dedup._universal()
    for _ in range(40):
        whole = draw.integers(0, 1 << 63, 700, np.uint64)
        x, y = near_dedup.minima(whole[:612], a, b), near_dedup.minima(whole[88:], a, b)  # 524 / 700
        same = (x == y).reshape(near_dedup.BANDS, near_dedup.ROWS)
        assert same.all(axis=1).any() and abs(same.mean() - 0.749) < near_dedup.SLACK


@pytest.fixture(scope="module")
def model():
    return pieces.read_model()


HARD = [
    "", " ", "  two  spaces   here ", "a\tb\nc\n\n d", "日本語 テスト 😀 x", "x" * 300, "aaaa aaaa " * 20, "def f(x):\n    return x+1\n", "<s> </s> <0x0A> <unk>",
    " lead", "trail ", "Ünïcödé naïve façade", "-" * 41, "====  ====", "   \n   ", "  x", "é é", "𝔘𝔫𝔦 \x00 \x7f", "nothing" * 3000,
]


def test_pieces_equal_the_models_own_merges(model, texts):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    v = pieces.Vocabulary(model)
    encoder = pieces.Encoder(v)
    draw = random.Random(8)
    mixed = ["".join(draw.choices(["the", "ing", " ", "  ", "er", "a", "é", "\n", "_", "tion", "T", "1", "…"], k=60)) for _ in range(300)]
    for batch in (HARD, mixed, list(texts.values()), []):
        ids, ends = encoder.batch(batch)
        begins = [0, *ends.tolist()]
        got = [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]
        assert got == own.encode(batch)
        assert [v.decode(x) for x in got] == batch


def test_segments_by_plain_merges(model):
    v, draw = pieces.Vocabulary(model), random.Random(9)
    words = ["▁" * draw.randint(0, 3) + "".join(draw.choices("etaoinshrdlu", k=draw.randint(1, 14))) for _ in range(500)]
    for word, ids in zip(words, v.encode_segments(words)):
        assert [v.text_of[i] for i in ids.tolist()] == v.merged(word)[0]


def test_remembered_segments_are_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    encoder = pieces.Encoder(pieces.Vocabulary(model))
    first = encoder.batch(["one two three four five"])[0].tolist()
    assert encoder.batch(["six"])[0].tolist() and encoder.batch(["one two three four five"])[0].tolist() == first


def test_encoding_takes_few_calls_a_segment(model):
    draw, v = random.Random(10), pieces.Vocabulary(model)
    text = " ".join("".join(draw.choices("etaoinshrdlu…", k=8)) for _ in range(16_000))

    def calls(encoder):
        profile = cProfile.Profile()
        assert profile.runcall(encoder.batch, [text])[0].size
        return sum(e.callcount for e in profile.getstats())

    pieces.Encoder(v).batch([text])  # judges the pairs
    encoder = pieces.Encoder(v)
    assert calls(encoder) < 10 * 16_000  # new words
    assert calls(encoder) < 500  # words seen before


def test_judged_pairs_are_bounded(model, texts, monkeypatch):
    batch = list(texts.values())[:40]
    ids, ends = pieces.Encoder(pieces.Vocabulary(model)).batch(batch)
    monkeypatch.setattr(pieces, "JUDGED", 7)
    v = pieces.Vocabulary(model)
    again = pieces.Encoder(v).batch(batch)
    assert ids.tolist() == again[0].tolist() and ends.tolist() == again[1].tolist() and len(v.follows) == 7


def test_pieces_of_odd_rows(odd, none, model):
    out = pieces.encode_documents(odd, model=model)
    rows = out.collect()
    assert len(rows) == odd.count() and pieces.encode_documents(none, model=model).count() == 0
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].ids == by_id[2].ids == [] and all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    back = {r.doc_id: r.t for r in out.select("doc_id", pieces.decoded(model, "ids").alias("t")).collect()}
    assert back[9] == "naïve café 😀 日本語\x0bend" and back[8] == "x" * 50_000
    blank = odd.limit(1).select(F.lit(7).alias("doc_id"), F.lit("a ▁b").alias("text"))
    assert not pieces.encode_documents(blank, model=model).first().round_trip


def test_pipeline_stages(llm, data, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "pii", "mixing", "sentencepiece"]
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, docs, data).persist()
        seen[name] = {r.doc_id: r for r in out.collect()}
        if name != "sentencepiece":
            assert out.columns == documents.columns and dict(out.dtypes) == dict(documents.dtypes)
        docs = out
    assert set(seen["near_dedup"]) <= set(seen["quality_rules"]) < {r.doc_id for r in documents.collect()}
    root, _ = plain_groups({i: r.text for i, r in seen["quality_rules"].items()})
    assert set(seen["near_dedup"]) == set(root.values())
    assert set(seen["pii"]) == set(seen["near_dedup"])
    changed = [i for i, r in seen["pii"].items() if r.text != seen["near_dedup"][i].text]
    assert changed and all("[" in seen["pii"][i].text and seen["pii"][i].n_chars == len(seen["pii"][i].text) for i in changed)
    assert set(seen["sentencepiece"]) == set(seen["mixing"]) <= set(seen["pii"])
    assert all(r.round_trip for r in seen["sentencepiece"].values())


def test_pipeline_on_odd_rows(llm, data, odd, none):
    words = " ".join(f"word{i}" for i in range(80))
    frame = odd.select("doc_id", "text", "source").union(
        llm.createDataFrame([(None, words, "a"), (None, words, "b"), (20, words, "a"), (20, words + " more", "a"), (21, f"{words} a@b.co", None)], "doc_id long, text string, source string")
    ).withColumns({"lang": F.lit("en"), "n_chars": F.lit(0).cast("long"), "kept": F.lit("own"), "id_": F.lit("own")})
    frame = frame.drop("id_")
    for docs in (frame, frame.filter("false")):
        kept = []
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(llm, docs, data).persist()
            kept.append(docs.count())
        assert kept[1] <= 1 if kept[0] else kept == [0] * 5


def near_copies(n, words, edits, seed, vocabulary=4000):
    """Copies of one text with so many words replaced, each at places of its own."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(vocabulary)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for at in draw.sample(range(words), draw.randrange(*edits)):
            copy[at] = f"e{draw.randrange(vocabulary)}"
        yield " ".join(copy)


@pytest.mark.parametrize("blocks", [256, 40])
def test_groups_of_many_near_copies_around_the_threshold(llm, monkeypatch, blocks):
    """Hundreds of copies that are 0.5 to 0.8 alike to each other: links are rare, and none is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", blocks)
    texts = dict(enumerate([*near_copies(450, 120, (2, 7), 1), *near_copies(60, 80, (0, 4), 2), *near_copies(40, 200, (5, 9), 3)]))
    roots, sizes = plain_groups(texts)
    rows = near_dedup.near_duplicates(llm.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in rows} == roots and {r.doc_id: r.n_shingles for r in rows} == sizes
    assert len(set(roots.values())) > 20


def test_overlaps_and_forest():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 9000, draw.integers(0, 6000))) for _ in range(14)]
    left, right = np.arange(5), np.arange(5, 14)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert near_dedup.overlaps(sets, left, right).tolist() == want
    assert near_dedup._forest(np.array([0, 1, 2, 0, 5]), np.array([1, 2, 0, 2, 6]), 8) == [(0, 1), (1, 2), (5, 6)]
