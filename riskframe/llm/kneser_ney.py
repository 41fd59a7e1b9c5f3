"""Interpolated modified Kneser-Ney scores from word pairs counted on Spark and memory-mapped by the workers.

Counting: every task reduces its texts to distinct (word, next word) hashes with counts and deals them to the cells of
a square grid, by the first word's hash to a row and by the second's to a column, so that no frequent word meets in one
cell. A cell sums its pairs, writes them as a sorted hash array with counts to the shared folder, and passes on what
its pairs say about their first words (followers seen once, twice, more often) and second words (count, distinct
predecessors). These are summed per word and written the same way.

Scoring: workers map the arrays (nothing is loaded whole) and look up the distinct pairs of a batch by binary search
in hash order. p(w | v) = max(c(vw) - D, 0) / c(v) + (D1 n1 + D2 n2 + D3 n3) / c(v) * p(w), and p(w) is the
same over distinct predecessors, interpolated with 1 / (V + 1), which is also what an unknown word gets.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskframe.llm.common import grid_side, strings, width, words_of
from riskframe.session import scratch_path

# a blank cannot stand in a word, so these are the hashes of no word
BEGIN, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" begin", b" end"))
CHUNK = 3_000_000  # tokens that a counting task reduces at once
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TURN = np.uint64(29)
_TOP = np.uint64(33)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v * _MIX) ^ (w + (v >> _TURN))
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> _TURN)


def part(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> _TOP) % np.uint64(n)).astype(np.int64)


class Codes:
    """Word hashes, each distinct word hashed once."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """BEGIN, words, END of every text in a row, and the lengths."""
        if len(self.seen) > 400_000:
            self.seen = {}
        seen, out = self.seen, []
        for t in texts:
            words = words_of(t)
            for w in set(words).difference(seen):
                seen[w] = xxhash.xxh64_intdigest(w)
            out.append(np.fromiter((seen[w] for w in words), np.uint64, len(words)))
        lengths = np.array([len(x) + 2 for x in out], np.int64)
        flat = np.empty(lengths.sum(), np.uint64)
        ends = np.cumsum(lengths)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = inner[ends - lengths] = False
        flat[ends - lengths], flat[ends - 1] = BEGIN, END
        flat[inner] = np.concatenate(out) if out else np.zeros(0, np.uint64)
        return flat, lengths


def distinct_pairs(codes: np.ndarray, lengths: np.ndarray):
    """Distinct neighbouring pairs (first, second, count) and, per token after BEGIN, its pair."""
    names, ids = np.unique(codes, return_inverse=True)
    second = np.ones(len(codes), bool)
    second[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(second)
    pairs, back, counts = np.unique(ids[at - 1] * len(names) + ids[at], return_inverse=True, return_counts=True)
    return names[pairs // len(names)], names[pairs % len(names)], counts, back


def _dealt(cell: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
    """(cell, bytes of each column) for every cell present."""
    order = np.argsort(cell, kind="stable")
    cell, columns = cell[order], [c[order] for c in columns]
    found, starts = np.unique(cell, return_index=True)
    for k, a, b in zip(found.tolist(), starts, [*starts[1:], len(cell)]):
        yield (k, *[c[a:b].tobytes() for c in columns])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first, axis=0) if len(first) else values[:0]


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (pyarrow.fs.LocalFileSystem(), folder)


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write under a name of its own, then rename: a repeated or doubled task leaves one whole file."""
    fs, path = _place(folder)
    own = f"{path}/{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with fs.open_output_stream(own) as f:
        np.lib.format.write_array(f, np.ascontiguousarray(array))
    fs.move(own, f"{path}/{name}.npy")


_MAPPED: dict[tuple[str, str], np.ndarray] = {}
_COPIES: list[tempfile.TemporaryDirectory] = []


def mapped(folder: str, name: str) -> np.ndarray:
    """A stored array, memory-mapped; a remote file is copied to this process's own folder first."""
    if (folder, name) not in _MAPPED:
        if any(f != folder for f, _ in _MAPPED):
            _MAPPED.clear()
            _COPIES.clear()
        fs, path = _place(folder)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            local = f"{path}/{name}.npy"
        else:
            _COPIES.append(tempfile.TemporaryDirectory())
            local = f"{_COPIES[-1].name}/{name}.npy"
            with fs.open_input_stream(f"{path}/{name}.npy") as f, open(local, "wb") as out:
                while block := f.read(1 << 24):
                    out.write(block)
        with open(local, "rb") as f:
            empty = not np.prod(np.lib.format.read_array_header_1_0(f)[0]) if np.lib.format.read_magic(f) else True
        _MAPPED[folder, name] = np.load(local) if empty else np.load(local, mmap_mode="r")
    return _MAPPED[folder, name]


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many things were counted once, twice, three and four times; 0.75 k where that has no value."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


@dataclass(frozen=True)
class Model:
    folder: str
    side: int  # of the grid of pair files
    buckets: int  # of word files
    tokens: int  # N
    types: int  # V
    pair_types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    left: float  # of the words' discounted mass: what the uniform share gets


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count all texts and store the arrays in a new folder under the shared one.

    A null text counts as empty: its end is one token. No texts give a model without words, by which every token has
    probability 1 / (V + 1) = 1.
    """
    spark = docs.sparkSession
    folder, side, buckets = scratch_path(spark, "kneser-ney"), grid_side(spark), width(spark)
    fs, path = _place(folder)
    fs.create_dir(path, recursive=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, sizes, total = Codes(), [], [], 0

        def flush():
            v, w, c, _ = distinct_pairs(np.concatenate(held), np.concatenate(sizes))
            cell = part(v, side) * side + part(w, side)
            for row in _dealt(cell, [v, w, c.astype(np.uint32)]):
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *[pa.array([x], pa.binary()) for x in row[1:]]], ["cell", "v", "w", "c"])

        for batch in batches:
            codes, lengths = coder(strings(batch.column(0)))
            held.append(codes), sizes.append(lengths)
            total += len(codes)
            if total >= CHUNK:
                yield from flush()
                held, sizes, total = [], [], 0
        if total:
            yield from flush()

    def cells(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        v, w, c = _joined(table["v"], np.uint64), _joined(table["w"], np.uint64), _joined(table["c"], np.uint32).astype(np.int64)
        keys = pair_keys(v, w)
        order = np.argsort(keys, kind="stable")
        keys, v, w, c = keys[order], v[order], w[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, v, w, c = keys[first], v[first], w[first], np.add.reduceat(c, first)
        save(folder, f"pairs-{cell}-keys", keys)
        save(folder, f"pairs-{cell}-counts", c.astype(np.uint32))
        # columns of a word: own count, predecessors, count as first word, followers seen once, twice, more often
        zero = np.zeros(len(c), np.int64)
        firsts = _summed(v, np.column_stack([zero, zero, c, c == 1, c == 2, c > 2]).astype(np.int64))
        seconds = _summed(w, np.column_stack([c, zero + 1, zero, zero, zero, zero]))
        words, sums = _summed(np.concatenate([firsts[0], seconds[0]]), np.concatenate([firsts[1], seconds[1]]))
        rows = list(_dealt(part(words, buckets), [words, sums.astype(np.uint32)]))
        own = [int((c == k).sum()) for k in (1, 2, 3, 4)] + [len(c)]
        rows.append((cell % buckets, b"", b""))
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()), "words": pa.array([r[1] for r in rows], pa.binary()),
            "sums": pa.array([r[2] for r in rows], pa.binary()), "own": pa.array([[]] * (len(rows) - 1) + [own], pa.list_(pa.int64())),
        })

    def buckets_of(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        words, sums = _summed(_joined(table["words"], np.uint64), _joined(table["sums"], np.uint32).reshape(-1, 6).astype(np.int64))
        save(folder, f"words-{bucket}-keys", words)
        save(folder, f"words-{bucket}-sums", np.minimum(sums, np.iinfo(np.uint32).max).astype(np.uint32))
        own = np.array([x for x in table["own"].to_pylist() if x], np.int64).reshape(-1, 5).sum(axis=0)
        known = sums[:, 1]
        totals = [int(sums[:, 0].sum()), int((known > 0).sum()), int(known.sum()), *[int((known == k).sum()) for k in (1, 2, 3, 4)], *own.tolist()]
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "totals": pa.array([totals], pa.list_(pa.int64()))})

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "cell int, v binary, w binary, c binary")
    summed = counted.groupBy("cell").applyInArrow(cells, "bucket int, words binary, sums binary, own array<long>")
    rows = summed.groupBy("bucket").applyInArrow(buckets_of, "bucket int, totals array<long>").collect()  # one row per word file
    totals = np.array([r["totals"] for r in rows], np.int64).reshape(-1, 12).sum(axis=0).tolist()
    tokens, types, pair_types = totals[:3]
    word_d, pair_d = discounts(totals[3:7]), discounts(totals[7:11])
    m1, m2 = totals[3:5]
    left = (word_d[0] * m1 + word_d[1] * m2 + word_d[2] * (types - m1 - m2)) / pair_types if pair_types else 1.0
    return Model(folder, side, buckets, tokens, types, pair_types, pair_d, word_d, left)


def _found(folder: str, prefix: str, values: str, files: np.ndarray, keys: np.ndarray, columns: int | None) -> np.ndarray:
    """What the stored arrays hold for sorted distinct keys, each in its file; 0 where a key is missing."""
    out = np.zeros((len(keys), columns) if columns else len(keys), np.int64)
    order = np.argsort(files, kind="stable")
    present, starts = np.unique(files[order], return_index=True)
    for k, a, b in zip(present.tolist(), starts, [*starts[1:], len(keys)]):
        rows = order[a:b]
        try:
            stored = mapped(folder, f"{prefix}-{k}-keys")
        except FileNotFoundError:  # no training text had a key of this file
            continue
        if len(stored):
            at = np.minimum(np.searchsorted(stored, keys[rows]), len(stored) - 1)
            hit = np.asarray(stored[at]) == keys[rows]
            out[rows[hit]] = mapped(folder, f"{prefix}-{k}-{values}")[at[hit]]
    return out


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


class Scorer:
    def __init__(self, model: Model):
        self.m, self.coder = model, Codes()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        m = self.m
        codes, lengths = self.coder(texts)
        v, w, _, back = distinct_pairs(codes, lengths)
        names, at = np.unique(np.concatenate([v, w]), return_inverse=True)
        stats = _found(m.folder, "words", "sums", part(names, m.buckets), names, 6)
        first, second = stats[at[:len(v)]], stats[at[len(v):]]
        keys = pair_keys(v, w)
        order = np.argsort(keys)
        together = np.empty(len(keys), np.int64)
        together[order] = _found(m.folder, "pairs", "counts", (part(v, m.side) * m.side + part(w, m.side))[order], keys[order], None)
        lower = _discounted(second[:, 1], m.word_discounts) / max(1, m.pair_types) + m.left / (m.types + 1)
        seen = np.maximum(first[:, 2], 1)
        d1, d2, d3 = m.pair_discounts
        passed = np.where(first[:, 2] > 0, (d1 * first[:, 3] + d2 * first[:, 4] + d3 * first[:, 5]) / seen, 1.0)
        score = np.log10(_discounted(together, m.pair_discounts) / seen + passed * lower)
        base = np.log10((second[:, 0] + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
        n = lengths - 1
        starts = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x[back], starts) if len(n) else np.zeros(0, x.dtype)
        return n, add((second[:, 0] > 0).astype(np.int64)), add(base), add(score)


SCORES = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("perplexity", T.DoubleType()),
])


def scored(model: Model, text: str | Column) -> Column:
    """A struct of ``SCORES``: log10 probabilities of the whole text and its end, and the perplexity per token.

    A null or empty text is its end alone. Each row is scored by itself: repeated rows score alike, other columns
    play no part.
    """
    @F.arrow_udf(SCORES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            n, known, base, score = scorer(strings(batch))
            columns = [n, known, base, score, 10 ** np.minimum(300, -score / np.maximum(n, 1))]
            yield pa.StructArray.from_arrays([pa.array(x) for x in columns], names=SCORES.names)

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)
