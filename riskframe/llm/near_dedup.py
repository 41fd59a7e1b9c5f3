"""MinHash near-duplicate groups.

Every text becomes its set of distinct five-word shingles. Many universal hash minima form its signature; bands of
minima are bucket keys. Texts with equal sets are one class from the start. In a bucket no pairs are listed: every
member is paired with the bucket's most connected member only. A pair must pass
the signature estimate and is confirmed on the full sets. Members of buckets that still hold several components lose those
whose own shingles, held by no other of them, rule out every link; the rest are compared block by block on their full
sets, and only the links that join components are returned. Components come from alternating large-star and small-star
steps. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import strings, stored, words_of

WORDS = 5
LEAST_PCT = 75
BANDS, ROWS = 48, 5  # a pair at 0.75 is missed by all bands with probability 2.3e-6
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 250_000  # of a block, on the average
COLUMNS = 4096  # members that are compared at once
SLACK = 0.14  # five deviations of the signature estimate at 0.75
BROADCAST_IDS = 1_000_000  # ids of eight bytes; more are joined by shuffle
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, no words none."""
    words = words_of(text)
    n = len(words)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), n)] if n else [], np.uint64)
    seen = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    codes = np.fromiter((seen[w] for w in words), np.uint64, n)
    total = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += _mixed(codes[k:n - WORDS + 1 + k] + _PLACES[k]) * _PLACES[k]
    return np.unique(_mixed(total))


def _universal() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20260101)
    a = draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def minima(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash a * x + b mod 2^64 over the set, in blocks that stay in cache."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(members), 256):
        block = members[start:start + 256, None] * a
        block += b
        np.minimum(best, block.min(axis=0), out=best)
    return best


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, signature) per row; the last three null for an empty set."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _universal()
        salt = np.arange(BANDS, dtype=np.uint64) * _PLACES[1]
        for batch in batches:
            sizes, keys, bands, signatures = [], [], [], []
            for t in strings(batch.column(1)):
                members = shingles(t)
                sizes.append(len(members))
                if not len(members):
                    keys.append(None), bands.append(None), signatures.append(None)
                    continue
                low = minima(members, a, b)
                mixed = _mixed(low)
                keys.append(xxhash.xxh3_128_digest(members.tobytes()))
                rows = mixed.reshape(BANDS, ROWS)
                band = salt.copy()
                for k in range(ROWS):
                    band = _mixed(band + rows[:, k] * _PLACES[k])
                bands.append(band.view(np.int64))
                signatures.append((mixed & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "bands", "signature"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>, signature binary"
    )


def with_ids(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on an id; the ids are broadcast if there are few, else joined by shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, column, how)


def _agreement(a: str, b: str):
    @F.arrow_udf("double")
    def share(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist())
        return pa.array([float(np.mean(np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8))) for p, q in pairs], pa.float64())

    return share(a, b)


def full_sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(c, members): the shingle sets of the documents with these ids."""
    wanted = with_ids(docs.select(F.col(doc_id).alias("c"), F.col(text).cast("string").alias("text")), ids, "c")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t).view(np.int64) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["c", "members"])

    return wanted.mapInArrow(sets, f"c {dict(ids.dtypes)['c']}, members array<long>")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough and whose full sets reach the threshold, as (a, b)."""
    marks = reps.select("c", "signature")
    near = (
        pairs.join(marks.select(F.col("c").alias("a"), F.col("signature").alias("sa")), "a")
        .join(marks.select(F.col("c").alias("b"), F.col("signature").alias("sb")), "b")
        .filter(_agreement("sa", "sb") >= LEAST_PCT / 100 - SLACK).select("a", "b")
    )
    near = stored(near, "dedup-near")
    members = stored(full_sets(docs, near.select(F.explode(F.array("a", "b")).alias("c")).distinct(), doc_id, text), "dedup-sets")
    both = near.join(members.select(F.col("c").alias("a"), F.col("members").alias("ma")), "a").join(
        members.select(F.col("c").alias("b"), F.col("members").alias("mb")), "b"
    )
    shared = F.size(F.array_intersect("ma", "mb")).cast("long")
    union = F.size("ma").cast("long") + F.size("mb") - shared
    return both.withColumns({"shared": shared, "union": union}).filter(100 * F.col("shared") >= LEAST_PCT * F.col("union")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(c, root) of every node of the edges (a, b), root the smallest of its component, by large-star and small-star."""
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = stored(edges.filter("a != b").select(hi.alias("a"), lo.alias("b")).distinct(), "dedup-edges")
    before = None
    while True:
        # large star: link every larger neighbour of a node to the smallest of the node and its neighbours
        around = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: link a node and its smaller neighbours to the smallest of these
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        now = stored(small, "dedup-stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("a").alias("c"), F.col("b").alias("root"))
        before = tuple(state)


def _alike_in_size(n: str, m: str):
    return 100 * F.least(n, m) >= LEAST_PCT * F.greatest(n, m)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[l, r]: how many members the sets share, from bit rows over the members that two of them hold at least."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, held = np.unique(flat, return_inverse=True, return_counts=True)
    common = held > 1
    column = np.cumsum(common) - 1
    use = common[place]
    owner, column = owner[use], column[place[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(common.sum()), COLUMNS):
        low, high = np.searchsorted(column, (start, start + COLUMNS))
        rows = np.zeros((len(sets), COLUMNS), np.float32)
        rows[owner[low:high], column[low:high] - start] = 1
        shared += rows[left] @ rows[right].T  # counts below 2^24 are exact
    return shared.astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The links that join what the links before them have not."""
    root, out = list(range(n)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def block_links(rest: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(a, b): links that join all texts which are alike enough among the members of the buckets ``rest`` (key, c, n, comp).

    Buckets that share members form a group. A group is dealt into blocks of a bounded number of texts and shingles, and
    every two blocks meet in one task, which compares their full sets as rows of bits and returns a spanning forest
    of the links it finds: rows grow with the members and blocks, never with the pairs, and no pair is left out.
    """
    kind = dict(rest.dtypes)["c"]
    low = rest.groupBy("key").agg(F.min("c").alias("low"))
    chained = components(rest.join(low, "key").filter("c != low").select(*_pair("c", "low")).distinct())
    members = rest.groupBy("c", "comp").agg(F.max("n").alias("n")).join(chained, "c", "left").withColumn("g", F.coalesce("root", "c")).drop("root")
    members = stored(members, "dedup-members")
    sizes = members.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = stored(full_sets(docs, members.select("c").distinct(), doc_id, text), "dedup-sets")
    met = dealt.join(sets, "c").select(
        "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "comp", "members"
    )

    def test(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, comp = table.column("block").to_numpy(), table.column("comp").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("members")]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            size = np.array([len(s) for s in sets])
            shared = overlaps(sets, left, right)
            union = size[left][:, None] + size[right][None, :] - shared
            near = (100 * shared >= LEAST_PCT * union) & (comp[left][:, None] != comp[right][None, :])
            a, b = np.nonzero(near)
            found = _forest(left[a], right[b], len(sets))
        ids = table.column("c").combine_chunks()
        a, b = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
        return pa.table({"a": ids.take(a), "b": ids.take(b)})

    return met.groupBy("g", "i", "j").applyInArrow(test, f"a {kind}, b {kind}").select(*_pair("a", "b"))


def _pair(a, b):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    ``component_id`` is the smallest doc_id reached over links of at least 75 % shingle overlap, itself included;
    ``kept`` is doc_id = component_id. A null, empty or blank text has no shingles and is linked with nothing. Rows
    that repeat one id are one document: each gets its own count, the id's links are those of all its texts. A row
    without id belongs to the group of an equal text that has one (not kept); without such a text its component is
    null, and it is kept. Other columns play no part; no rows give no rows.
    """
    rows = stored(sketches(docs, doc_id, text), "dedup-sketches")
    classes = stored(
        rows.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("c")).filter("c is not null"), "dedup-classes"
    )
    reps = rows.filter("set_key is not null").withColumnRenamed("doc_id", "c").join(classes, ["c", "set_key"], "left_semi")
    members = reps.select("c", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("m")).filter("x < y")
    buckets = stored(members.join(shared.select("key", "m"), "key"), "dedup-buckets")
    degree = buckets.groupBy("c").agg(F.sum("m").alias("degree"))
    ranked = stored(buckets.join(degree, "c").select("key", "c", "n", "degree"), "dedup-ranked")
    involved = reps.join(degree.select("c"), "c", "left_semi").select("c", "signature")
    involved = stored(involved, "dedup-signatures")
    # ids with several sets: their classes are linked, and what one of their texts holds alone says nothing of another
    named = rows.filter("set_key is not null and doc_id is not null")
    several = named.withColumn("h", F.xxhash64("set_key")).groupBy("doc_id").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x < y")
    several = stored(several.select("doc_id"), "dedup-several")
    of_one = with_ids(named, several, "doc_id").select("doc_id", "set_key").distinct().join(classes, "set_key")
    own_links = of_one.filter("doc_id != c").select(*_pair("doc_id", "c")).distinct()

    center = ranked.groupBy("key").agg(F.max_by(F.struct("c", "n"), F.struct("degree", F.xxhash64("c"), "c")).alias("center"))
    paired = ranked.join(center, "key").filter((F.col("c") != F.col("center.c")) & _alike_in_size("n", "center.n"))
    tried = stored(paired.select(*_pair("c", "center.c")).distinct(), "dedup-tried")
    edges = stored(confirmed(tried, involved, docs, doc_id, text).union(own_links), "dedup-links")

    def uncovered(frame: DataFrame, roots: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one component, with their component."""
        labelled = frame.join(roots, "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root")
        mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
        return stored(labelled.join(mixed, "key", "left_semi"), "dedup-mixed")

    roots = components(edges)
    mixed = uncovered(ranked, roots).drop("comp")
    rest = mixed.select("c", "n").distinct()
    if not rest.isEmpty():
        # a shingle that no other of these texts holds can only part its text from them: most such texts need no comparison
        held = full_sets(docs, rest.select("c").distinct(), doc_id, text).select("c", F.explode("members").alias("shingle"))
        own = held.groupBy("shingle").agg(F.min("c").alias("c"), F.max("c").alias("d")).filter("c = d").groupBy("c").agg(F.count(F.lit(1)).alias("own"))
        own = with_ids(own, several.withColumnRenamed("doc_id", "c"), "c", "left_anti")
        able = rest.join(own, "c", "left").filter(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= LEAST_PCT * F.col("n"))
        rest = uncovered(mixed.join(able.select("c").distinct(), "c", "left_semi"), roots)
        edges = stored(edges.union(block_links(rest, docs, doc_id, text)), "dedup-links")
        roots = components(edges)

    named = rows.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    found = named.join(roots, "c", "left").withColumn(
        "component_id", F.coalesce("root", "c", "doc_id")
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select(F.col("doc_id").alias(doc_id), "n_shingles", "component_id", kept.alias("kept"))
