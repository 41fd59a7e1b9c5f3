"""Quality rules, URL rules, mixing, fingerprints: brute force, SQL, odd rows, empty tables."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, compare
from riskframe.llm import fingerprint, mixing, quality_rules, queries, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(llm, data, name):
    if queries.ORACLES[name]:
        assert compare(connect(data), queries.QUERIES[name](llm, data), queries.ORACLES[name]) is None


def plain_rules(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = text.split("\n")
    repeats = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(covered), failed


def test_quality_counts(llm, documents, texts):
    rows = documents.select("doc_id", quality_rules.quality("text").alias("q")).select("doc_id", "q.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == plain_rules(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_bands():
    import random
    import string

    import zstandard

    packer, draw = zstandard.ZstdCompressor(level=3), random.Random(1)
    prose = " ".join("".join(draw.choices("etaoinshr", k=draw.randint(2, 9))) for _ in range(900))
    noise = "".join(draw.choices(string.printable[:94], k=9000))
    assert quality_rules.compression(prose.encode(), packer)[3]
    assert not quality_rules.compression(b"again and " * 900, packer)[3]
    assert not quality_rules.compression(noise.encode(), packer)[3]
    half = prose.encode()[:5000] + b"same " * 8000
    assert not quality_rules.compression(half, packer)[3]
    assert quality_rules.compression(b"", packer) == (0.0, 0, 0, True)


def test_quality_odd_rows(odd, none):
    out = odd.select("doc_id", quality_rules.quality("text").alias("q")).select("doc_id", "q.*")
    rows = out.collect()
    assert len(rows) == odd.count() and none.select(quality_rules.quality("text")).count() == 0
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[6].n_repeat_words == 30_000 and by_id[6].base_failed


def test_mix_odd_rows(odd, none):
    rows = mixing.mix(odd, carry=True).collect()
    assert len(rows) == odd.count() and mixing.mix(none).count() == 0
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    total = sum(r.size for r in rows)
    targets = {r.row.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s for s, t in targets.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd, carry=True).collect()))


def test_targets_share_what_a_cap_frees(llm):
    frame = llm.createDataFrame([("a", 1000, 1), ("b", 10, 1), ("c", 500, 1), (None, 90, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}  # weights 1, 2, 3, 1
    assert got["b"] == 30 and got[None] == 270 and got["a"] + got["c"] == pytest.approx(1300) and got["c"] == pytest.approx(975)


def test_sainte_lague_by_hand(llm):
    frame = llm.createDataFrame([(1, 53000.0, 100, 7), (2, 24000.0, 100, 7), (3, 23000.0, 100, 7), (4, 0.0, 100, 7)], "unit int, claim double, most long, seats long")
    got = {r.unit: r.quota for r in mixing.sainte_lague(frame, [], "unit").collect()}
    quotients = sorted(((c / (2 * k + 1), -u) for u, c in ((1, 53000), (2, 24000), (3, 23000)) for k in range(7)), reverse=True)[:7]
    assert got == {**{u: sum(-x == u for _, x in quotients) for u in (1, 2, 3)}, 4: 0}


def test_mixed_documents_hold_the_words_taken(documents):
    taken = mixing.mix(documents).select("doc_id", "taken").collect()
    texts = mixing.mixed_documents(documents)
    assert texts.columns == documents.columns
    got = {r.doc_id: r.n for r in texts.groupBy("doc_id").agg(F.sum(mixing.size_of("text")).alias("n")).collect()}
    assert got == {r.doc_id: r.taken for r in taken if r.taken}


def test_words_from_keeps_white_space(llm):
    frame = llm.createDataFrame([("  a\tbb \n c  d",)], "t string")
    cut = lambda i, n: frame.select(mixing.words_from(F.col("t"), F.lit(i), F.lit(n)).alias("x")).first().x
    assert cut(0, 2) == "a\tbb \n " and cut(2, 5) == "c  d"


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.example.org", "/es/x", "allow"), ("", "/private", "block"), ("com", "", "block"),
         ("com", "", "allow"), ("x.com", "/a/b", "allow"), ("x.com", "/a", "allow"), ("x.com", "/a/bc", "block")]
URLS = ["http://www.example.org/es/1", "http://A.Example.ORG/es/xy", "http://z.net/private/1", "http://z.net/p", "https://x.com/a/b/c", "https://y.x.com/a/bcd",
        "https://x.com", "https://x.com?q=/a", None, "", "no scheme", "ftp://org", "http://org/", "http://myexample.org/es/", "://", "http://x.com/a#/b"]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, 0, None, "allow")
    return host, path, best[3], best[4]


def test_url_rules_against_all_rules(llm):
    rules = llm.createDataFrame(RULES, "host string, path string, verdict string")
    urls = [(i, u, "own") for i, u in enumerate(URLS * 40)] + [(None, URLS[0], "own")]
    frame = llm.createDataFrame(urls, "page_id long, url string, key string")
    rows = url_filter.url_verdicts(frame, rules).collect()
    assert len(rows) == len(urls)
    want = collections.Counter((i, *plain_verdict(u)) for i, u, _ in urls)
    assert collections.Counter(tuple(r) for r in rows) == want
    assert url_filter.url_verdicts(frame.filter("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(frame, rules.filter("false"), default="block").collect()} == {"block"}


def test_sketch_is_mergeable_and_estimates_containment():
    import random

    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(6000)]
    whole, half = " ".join(words), " ".join(words[:3000])
    a, b = fingerprint.sketch(whole), fingerprint.sketch(half)
    near, in_a, in_b = fingerprint.likeness(b, a)
    assert in_a > 0.98 and abs(near - 0.5) < 0.05 and abs(in_b - 0.5) < 0.05
    both = fingerprint.sketch(" ".join(words[:3010]) + "\n")
    assert set(b) <= set(a) and len(set(both) - set(a)) <= 2
    assert fingerprint.sketch("").size == 0 and fingerprint.sketch("x").size == 1
    assert (fingerprint.from_text(fingerprint.as_text(a)) == a).all()


def test_fingerprints_of_edited_texts(documents, texts):
    rows = {r.doc_id: r for r in fingerprint.compare_with_edit(documents).collect()}
    ids = sorted(texts)
    for i, k in enumerate(ids):
        t, u = texts[k], texts[ids[(i + 1) % len(ids)]]
        edited = t[:len(t) - len(t) // 4] + u[:len(t) // 4]
        assert rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[k].n_chars == len(t)
        assert rows[k].fingerprint == fingerprint.as_text(fingerprint.sketch(t))
        assert rows[k].near_next == fingerprint.likeness(fingerprint.sketch(t), fingerprint.sketch(u))[0]


def test_fingerprints_odd_rows(odd, none):
    rows = fingerprint.compare_with_edit(odd).collect()
    assert len(rows) == odd.count() and fingerprint.compare_with_edit(none).count() == 0
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_chars == 0 and by_id[1].fingerprint == "" and by_id[1].near_next == 1.0 and by_id[2].near_next == 0.0
    assert by_id[6].near_next == 1.0 and by_id[6].fingerprint == by_id[7].fingerprint
    one = fingerprint.compare_with_edit(odd.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    got = odd.select(fingerprint.fingerprint("text").alias("a")).select(fingerprint.alike("a", "a").alias("x")).collect()
    assert all(r.x[0] == 1.0 for r in got)
