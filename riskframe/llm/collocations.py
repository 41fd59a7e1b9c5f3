"""Phrase collocations by direct-address tiling.

Tasks write their texts as chunks of word numbers, with the words of each chunk beside it. Frequent words are ranked by
falling frequency, and every chunk is rewritten in ranks. Neighbouring ranks (a, b) are then a cell of a square that is cut into tiles:
a tile that holds many pairs is counted by one ``bincount`` over its cells, the others by sorting their codes. What
the chunks counted is added up by Spark. Frequent pairs are ranked anew and the chunks rewritten in their ranks, so the
neighbours of the next round are phrases one word longer, down from two words to the longest asked for.

A phrase is no more frequent than any part of it, so no round loses a phrase that counts. Chunks are of bounded size. The ranks
of a round go to all tasks if there are few, by a count; more of them are joined to the chunks that hold them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskframe.llm.common import stored, width

TOKENS = 120_000  # words of a chunk, so that its row is no large object; a task holds HELD words over all languages
HELD = 1_000_000
SLAB = 1 << 20  # bytes of a text that are cut into words at once
BITS = 10  # a tile has 2^BITS by 2^BITS cells
DENSE = 1 << 14  # pairs from which a tile is counted by its cells
CODE = 32  # bits of a rank in the code of a pair
SALTS = 64
# . , ; : ! ? and line feed to carriage return end a piece; bytes so that letters of any script stay whole
_PIECES = bytes(0x2E if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
RANKS = 1_000_000  # symbols whose ranks are broadcast; more are joined to the chunks that hold them
MERGED = 1_000_000  # pairs whose counts a task holds
_CHUNK = "chunk long, lang string, body long, n long, width int, seq binary, words binary, counts binary"
_NAMES = [c.split(" ")[0] for c in _CHUNK.split(", ")]


# ---------------------------------------------------------------- chunks

def _packed(seq: np.ndarray) -> tuple[int, bytes]:
    """Numbers from -1 up in the smallest unsigned type that holds them, plus one."""
    top = int(seq.max(initial=-1)) + 1
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    return np.dtype(kind).itemsize, (seq + 1).astype(kind).tobytes()


def _unpacked(size: int, data) -> np.ndarray:
    kind = np.int32 if size < 4 else np.int64
    seq = np.frombuffer(data, f"<u{size}").astype(kind)
    seq -= 1
    return seq


def _row(chunk: int, lang: str, body: int, n: int, seq: np.ndarray, words: bytes | None = None, counts: bytes | None = None) -> pa.RecordBatch:
    values = [chunk, lang, body, n, *_packed(seq), words, counts]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], _NAMES)


def _opened(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    """(chunk, lang, body, n, sequence, words, counts) of each chunk."""
    for batch in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
        for i in range(batch.num_rows):
            chunk, lang, body, n, size, data, words, counts = (c[i].as_py() for c in batch.columns)
            yield chunk, lang, body, n, _unpacked(size, data), words, counts


class _Words:
    """The words of one language that a task has read and not yet written: numbers from 1, 0 between pieces."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[b"."]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def chunk(self, ahead: int) -> tuple[int, np.ndarray, list[bytes], np.ndarray, list[bytes]]:
        """(words that begin phrases, sequence from -1, words, their counts, the last words again for the next chunk)."""
        seq = np.concatenate(self.parts)
        names = list(self.numbers)
        body = len(seq) - ahead
        counts = np.bincount(seq[:body], minlength=len(names))[1:]
        return body, seq - 1, names[1:], counts, [names[i] for i in seq[body:]]


def encoded(docs: DataFrame, lang: str, text: str, longest: int, tokens: int = TOKENS, slab: int = SLAB) -> DataFrame:
    """The chunks of all texts, each with its words and their counts.

    A chunk ends where a text ends, but a text past two chunks is cut: the words after the cut that a phrase can reach are
    written with both chunks and begin phrases only in the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Words] = {}
        made = TaskContext.get().partitionId() << 32

        def closed(name: str, ahead: int = 0) -> Iterator[pa.RecordBatch]:
            nonlocal made
            body, seq, words, counts, again = open_.pop(name).chunk(ahead)
            yield _row(made, name, body, int(counts.sum()), seq, b" ".join(words), counts.astype(np.int64).tobytes())
            made += 1
            if again:
                open_[name] = _Words()
                open_[name].add(again)

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = raw.as_buffer()
                if data is None or not len(data):
                    continue
                spaced = data.to_pybytes().lower().translate(_PIECES).replace(b".", b" . ")
                start = 0
                while start < len(spaced):
                    end = spaced.find(b" ", start + slab)
                    end = len(spaced) if end < 0 else end
                    words = spaced[start:end].split()
                    start = end
                    if words:
                        open_.setdefault(name, _Words()).add(words)
                        if open_[name].size >= 2 * tokens:
                            yield from closed(name, longest - 1)
                if name in open_:
                    open_[name].add([b"."])
                    if open_[name].size >= tokens:
                        yield from closed(name)
            while sum(w.size for w in open_.values()) > max(HELD, 4 * tokens):
                yield from closed(max(open_, key=lambda x: open_[x].size))
        for name in list(open_):
            yield from closed(name)

    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, _CHUNK)


def word_counts(chunks: DataFrame) -> DataFrame:
    """(holder, lang, code, word, n): the words of every chunk with their numbers in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, _, _, _, words, counts in _opened(batch):
                words, counts = words.split(), np.frombuffer(counts, np.int64)
                for at in range(0, len(words), 65_536):
                    now = words[at:at + 65_536]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(now), chunk), pa.int64()), pa.array([lang] * len(now), pa.string()), pa.array(np.arange(at, at + len(now)), pa.int64()),
                            pa.array(now, pa.binary()), pa.array(counts[at:at + len(now)], pa.int64()),
                        ],
                        ["holder", "lang", "code", "word", "n"],
                    )

    return chunks.mapInArrow(run, "holder long, lang string, code long, word binary, n long")


# ---------------------------------------------------------------- tiles

def tiled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the pairs of ranks, tile by tile. ``a << CODE | b`` is the code; codes are distinct, not sorted."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    side, mask = (int(max(a.max(), b.max())) >> BITS) + 1, (1 << BITS) - 1
    tile = (a >> BITS).astype(np.int32 if side < 1 << 15 else np.int64) * side + (b >> BITS)
    order = np.argsort(tile, kind="stable")
    tile, a, b = tile[order], a[order].astype(np.int64), b[order].astype(np.int64)
    del order
    starts = np.r_[0, np.flatnonzero(np.diff(tile)) + 1, len(tile)]
    codes, counts, rest = [], [], []
    for low, high in zip(starts[:-1][np.diff(starts) >= DENSE], starts[1:][np.diff(starts) >= DENSE]):
        cells = np.bincount((a[low:high] & mask) << BITS | (b[low:high] & mask), minlength=1 << 2 * BITS)
        at = np.flatnonzero(cells)
        codes.append(((a[low] >> BITS << BITS) + (at >> BITS)) << CODE | ((b[low] >> BITS << BITS) + (at & mask)))
        counts.append(cells[at])
    sparse = np.repeat(np.diff(starts) < DENSE, np.diff(starts))
    rest = np.sort(a[sparse] << CODE | b[sparse])
    if len(rest):
        first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
        codes.append(rest[first])
        counts.append(np.diff(np.r_[first, len(rest)]))
    return np.concatenate(codes), np.concatenate(counts)


def _neighbours(seq: np.ndarray) -> np.ndarray:
    """The code of every pair of neighbours, -1 where one of them is no frequent symbol."""
    return np.where((seq[:-1] >= 0) & (seq[1:] >= 0), seq[:-1].astype(np.int64) << CODE | seq[1:], -1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes once each, in order, with the sums of their counts."""
    codes, counts = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(chunks: DataFrame, by_chunk: bool = False) -> DataFrame:
    """(holder, lang, code, n): the neighbours of the chunks, counted in tiles and added up inside a task.

    By chunk, every pair of the chunk is there, those that begin no phrase in it with 0; else ``holder`` is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def sent(name: str, chunk: int | None = None) -> Iterator[pa.RecordBatch]:
            codes, counts = _merged(held.pop(name))
            for at in range(0, len(codes), 65_536):
                z = slice(at, at + 65_536)
                rows = len(codes[z])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * rows, pa.int64()), pa.array([name] * rows, pa.string()), pa.array(codes[z]), pa.array(counts[z])],
                    ["holder", "lang", "code", "n"],
                )

        for batch in batches:
            for chunk, lang, body, _, seq, _, _ in _opened(batch):
                begins = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
                ahead, begins = begins[begins >= body], begins[begins < body]
                found = held.setdefault(lang, [])
                found.append(tiled(seq[begins], seq[begins + 1]))
                if by_chunk:
                    found.append((seq[ahead].astype(np.int64) << CODE | seq[ahead + 1], np.zeros(len(ahead), np.int64)))
                    yield from sent(lang, chunk)
                elif sum(len(c) for c, _ in found) > MERGED:
                    held[lang] = [_merged(found)]
                    if len(held[lang][0][0]) > MERGED // 2:
                        yield from sent(lang)
        for name in list(held):
            yield from sent(name)

    return chunks.mapInArrow(run, "holder long, lang string, code long, n long")


def rewritten(chunks: DataFrame, ranks: DataFrame, pairs: bool) -> DataFrame:
    """The chunks in the ranks of their symbols, words or pairs; ``ranks`` has lang, word or code, and id.

    Up to ``RANKS`` symbols, counted first, go to every task. More are joined to the symbols of each chunk, and a chunk meets
    only its own.
    """
    key = "code" if pairs else "word"

    def renewed(row: tuple, codes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """``codes`` in order, with a last one that never occurs."""
        chunk, lang, body, n, seq, _, _ = row
        old = _neighbours(seq) if pairs else seq
        at = np.searchsorted(codes, old)
        new = np.where(codes[at] == old, ids[at], -1)
        keep = (new >= 0) | np.r_[True, new[:-1] >= 0]  # one mark for a run of rare symbols
        return _row(chunk, lang, int(keep[:body].sum()), n, new[keep])

    last, none = np.iinfo(np.int64).max, np.full(1, -1)
    if ranks.limit(RANKS + 1).count() <= RANKS:
        table = ranks.select("lang", key, "id").toArrow()
        by_lang = {}
        for name in set(table.column("lang").to_pylist()):
            part = table.filter(pc.equal(table.column("lang"), name)).sort_by(key)
            by_lang[name] = part.column(key).combine_chunks(), part.column("id").to_numpy()
        shared = chunks.sparkSession.sparkContext.broadcast(by_lang)

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _opened(batch):
                    symbols, ids = shared.value.get(row[1], (None, none[:0]))
                    if not len(ids):
                        codes = none[:0]
                    elif pairs:
                        codes = symbols.to_numpy()
                    else:
                        place = pc.index_in(pa.array(row[5].split(), pa.binary()), value_set=symbols).to_numpy(zero_copy_only=False)
                        codes = np.flatnonzero(~np.isnan(place))
                        ids = ids[place[codes].astype(np.int64)]
                    yield renewed(row, np.append(codes, last), np.append(ids, -1))

        return chunks.mapInArrow(known, _CHUNK)
    held = pair_counts(chunks, True) if pairs else word_counts(chunks)
    wanted = held.join(ranks.select("lang", key, "id"), ["lang", key]).select("holder", "code", "id")

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, ids = right.column("code").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(codes)
        made = [renewed(row, np.append(codes[order], last), np.append(ids[order], -1)) for row in _opened(left)]
        return pa.Table.from_batches(made) if made else left

    return chunks.groupBy("chunk").cogroup(wanted.groupBy("holder")).applyInArrow(own, _CHUNK)


@contextmanager
def few_chunks_at_a_time(spark: SparkSession) -> Iterator[None]:
    """Few rows at once between Parquet, Spark and Python: the rows of many chunks would stand in memory several times."""
    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.parquet.columnarReaderBatchSize": "8"}
    before = {name: spark.conf.get(name) for name in few}
    for name, value in few.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def ranked(frequent: DataFrame, symbol: str, name: str) -> DataFrame:
    """``id`` by falling frequency within the language, from 0, from one range-partitioned sort."""
    order = [F.col("lang"), F.desc("f"), F.col(symbol)]
    sorted_ = frequent.repartitionByRange(width(frequent.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(sorted_.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    runs = placed.groupBy("lang", part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("size"))
    before = W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    runs = runs.select("lang", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    found = placed.withColumn("part", part).join(runs, ["lang", "part"]).withColumn("id", F.col("at") + F.col("shift"))
    fits = F.when(F.col("id") < 1 << 31, F.col("id")).otherwise(F.raise_error(F.lit("more than 2^31 frequent phrases of one length")))
    return found.withColumn("id", fits).drop("at", "part", "shift")


# ---------------------------------------------------------------- phrases

def _decimal(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """Adds ``best``: (score, k, l, r) of the lowest cut. ``starts`` and ``ends`` are the frequencies of the first and last 1, 2, ...
    words. Products take decimals of 38 digits; the quotient is a whole number."""
    size = F.size("starts")

    def cut(k: Column) -> Column:
        l_, r = F.element_at("starts", k), F.element_at("ends", size + 1 - k)
        top = (_decimal("a") * _decimal("n")) * F.lit(1000).cast("decimal(4,0)")
        bottom = _decimal(l_) * _decimal(r)
        return F.struct(F.call_function("div", top, bottom).alias("score"), k.alias("k"), l_.alias("l"), r.alias("r"))

    return phrases.withColumn("best", F.array_min(F.transform(F.sequence(F.lit(1), size), cut)))


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, first: int = 2000,
    tokens: int = TOKENS, slab: int = SLAB,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut at . , ; : ! ? and line ends into pieces and at blanks and tabs into words. A phrase
    counts if it occurs ``least`` times within pieces, overlaps included. Its score is the lowest floor(1000 a n / (l r)) over the
    cuts into two parts, with the smallest k on a tie; a, l, r are the frequencies of the phrase and its parts, n all words of the
    language. A phrase that always lies inside one longer phrase of at most ``longest`` words is left out. Order: score, a,
    phrase by UTF-8 bytes.

    A null or empty text has no words; a null language is ``und``, together with rows that say so. Repeated rows count each
    time. Other columns play no part; no rows give no rows.
    """
    chunks = stored(encoded(docs, lang, text, longest, tokens, slab), "phrases-chunks", 1)
    totals = stored(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    counted = word_counts(chunks).groupBy("lang", "word").agg(F.sum("n").alias("f"))
    with few_chunks_at_a_time(docs.sparkSession):
        frequent = stored(counted.filter(F.col("f") >= least), "phrases-frequent")
    empty = F.array().cast("array<long>")
    level = ranked(frequent, "word", "phrases-ranked").withColumns({"last": F.col("word"), "phrase": F.col("word"), "starts": empty, "ends": empty})
    level = stored(level.select("lang", "id", "f", "word", "phrase", "last", "starts", "ends"), "phrases-1")
    found = None
    for size in range(2, longest + 1):
        with few_chunks_at_a_time(docs.sparkSession):
            chunks = stored(rewritten(chunks, level, size > 2), f"phrases-chunks-{size}", 1)
            sums = pair_counts(chunks).groupBy("lang", "code").agg(F.sum("n").alias("f"))
            sums = stored(sums.filter(F.col("f") >= least), "phrases-frequent")
        pairs = ranked(sums, "code", "phrases-ranked")
        pairs = pairs.select("lang", "id", "f", "code", F.shiftright("code", CODE).alias("x"), F.col("code").bitwiseAND((1 << CODE) - 1).alias("y"))
        head = level.select("lang", F.col("id").alias("x"), F.col("phrase").alias("head"), F.col("f").alias("fx"), F.col("starts").alias("sx"))
        tail = level.select("lang", F.col("id").alias("y"), F.col("last").alias("tail"), F.col("f").alias("fy"), F.col("ends").alias("ey"))
        longer = pairs.join(head, ["lang", "x"]).join(tail, ["lang", "y"]).select(
            "lang", "id", "f", "code", "x", "y", F.concat("head", F.lit(b" "), "tail").alias("phrase"), F.col("tail").alias("last"),
            F.concat("sx", F.array("fx")).alias("starts"), F.concat("ey", F.array("fy")).alias("ends"),
        )
        longer = stored(longer, f"phrases-{size}")
        if size > 2:
            # a phrase inside a longer one lies inside one that is one word longer, as frequent as itself
            inside = longer.select("lang", F.col("x").alias("id"), "f").union(longer.select("lang", F.col("y").alias("id"), "f")).distinct()
            level = level.join(inside, ["lang", "id", "f"], "left_anti")
            found = level if found is None else found.unionByName(level.select(found.columns))
        if size == longest:
            found = longer if found is None else found.unionByName(longer.select(found.columns))
        level = longer
    if found is None:
        raise ValueError("phrases have two words at least")
    chosen = found.withColumnRenamed("f", "a").join(totals, "lang")
    rows = scored(chosen.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "n", "starts", "ends")).select(
        "lang", "phrase", "a", "best.l", "best.r", "n", "best.score"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))  # SALTS * first rows of a language at most
    return best.filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
