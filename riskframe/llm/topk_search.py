"""Exact top-k search by inner product, a block of documents at a time.

Rows are ordered by clusters and cut into ranges, the blocks. A dimension counts as two terms, its positive and its negative
part, and a block keeps the maximum of each term beside its forward index, the integer vectors themselves. For a query the
maxima, times its weights, sum to a bound for every row of the block. Blocks are scored in falling order of that
bound until it is below the k-th score found; a block at exactly that score is still scored, for the ties.

Queries are taken in slices of bounded size. A first pass over one block of each cluster gives every query a k-th score to
start from, so that tasks return few rows beside the final ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskframe.llm.common import stored
from riskframe.llm.vectors import EXACT, largest, matrix, products, scaled, usable

BLOCK_VALUES = 32_768  # of a forward index: 512 rows of 64 dimensions
CLUSTERS = 256
SAMPLE = 20_000  # rows that the clusters are fitted on; every row is put into a block
AT_ONCE = 32_768  # queries of a slice, on the average: what is broadcast is this many vectors
CHUNK = 2048  # queries whose bounds are held at once
LOWEST = -(1 << 63)


# ---------------------------------------------------------------- blocks

def _clusters(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """Centres of a few rounds of k-means over at most ``SAMPLE`` rows. They only decide which rows share a block."""
    every = max(1, n // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("x").limit(SAMPLE).toArrow()
    x = matrix(sample.column("x"), d).astype(np.float64)
    wanted = min(CLUSTERS, len(x), n * d // (4 * BLOCK_VALUES) + 1)
    centres = x[np.random.default_rng(20260303).permutation(len(x))[:wanted]]
    for _ in range(6):
        near = nearest(x, centres)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if len(centres) < 2:
        return np.zeros(len(x), np.int64)
    return (x @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)


def blocks(rows: DataFrame, d: int, centres: np.ndarray, n: int) -> DataFrame:
    """(cluster, first, rows, ids, width, index, high, low) of every block; ``first`` marks one block of each cluster."""
    per_block = max(1, BLOCK_VALUES // max(d, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest(matrix(batch.column(2), d).astype(np.float64), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["row", "id", "x", "cluster"])

    placed = stored(rows.select("row", "id", "x").mapInArrow(assign, "row long, id long, x array<long>, cluster int"), "topk-placed")
    sizes = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # CLUSTERS at most
    share = max(16 * per_block, n // 1024)
    parts = F.array(*[F.lit(-(-sizes.get(c, 1) // share)) for c in range(max(len(centres), 1))])  # a large cluster is dealt to several tasks
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.get(parts, F.col("cluster"))))
    dealt = dealt.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            cluster, part = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            x, row, ids = matrix(batch.column(2), d), batch.column(0).to_numpy(), batch.column(1)
            edges = np.flatnonzero((np.diff(cluster) != 0) | (np.diff(part) != 0)) + 1
            for at in np.split(np.arange(len(cluster)), edges):
                if not len(at):
                    continue
                key = (cluster[at[0]], part[at[0]])
                if held and held[0][0] != key:
                    yield _block(held)
                    held = []
                while len(at):
                    room = per_block - sum(len(h[1]) for h in held)
                    now, at = at[:room], at[room:]
                    held.append((key, row[now], ids.take(pa.array(now)), x[now]))
                    if len(now) == room:
                        yield _block(held)
                        held = []
        if held:
            yield _block(held)

    made = stored(
        dealt.select("row", "id", "x", "cluster", "part").mapInArrow(
            cut, "cluster int, least long, rows array<long>, ids array<long>, width int, index binary, high array<long>, low array<long>"
        ),
        "topk-blocks",
    )
    firsts = F.broadcast(made.groupBy("cluster").agg(F.min("least").alias("least")).withColumn("is_first", F.lit(True)))  # CLUSTERS rows
    return made.join(firsts, ["cluster", "least"], "left").withColumn("first", F.coalesce("is_first", F.lit(False))).drop("is_first")


def _block(held: list[tuple]) -> pa.RecordBatch:
    row = np.concatenate([h[1] for h in held])
    x = np.concatenate([h[3] for h in held])
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if t is np.int64 or largest(x) <= np.iinfo(t).max)
    lists = [pa.array([v], pa.list_(pa.int64())) for v in (row, pa.concat_arrays([h[2] for h in held]).to_pylist(), x.max(axis=0), x.min(axis=0))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([held[0][0][0]], pa.int32()), pa.array([row.min()], pa.int64()), lists[0], lists[1],
            pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary()), lists[2], lists[3],
        ],
        ["cluster", "least", "rows", "ids", "width", "index", "high", "low"],
    )


# ---------------------------------------------------------------- search inside a task

class Tops:
    """The k best of each query so far, as flat arrays ordered by query, score, id and row."""

    def __init__(self, k: int, start: np.ndarray):
        self.k, self.cut = k, start.copy()
        self.found = [np.zeros(0, np.int64) for _ in range(4)]  # query, score, id (nulls last), row * 2 + null

    def add(self, query, score, ids, mark) -> None:
        q, s, i, m = (np.concatenate(p) for p in zip(self.found, (query, score, ids, mark)))
        order = np.lexsort((m, i, ~s, q))  # ~s falls as s rises, without overflow
        q, s, i, m = q[order], s[order], i[order], m[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = place == self.k - 1
        self.cut[q[last]] = np.maximum(self.cut[q[last]], s[last])
        keep = place < self.k
        self.found = [q[keep], s[keep], i[keep], m[keep]]


@dataclass
class Block:
    rows: np.ndarray
    ids: np.ndarray
    marks: np.ndarray
    x: np.ndarray


def _read(batch: pa.RecordBatch, d: int) -> tuple[list[Block], np.ndarray, np.ndarray]:
    out = []
    for rows, ids, width, index in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
        rows, null = rows.values.to_numpy(), np.asarray(ids.values.is_null())
        ids = ids.values.fill_null((1 << 63) - 1).to_numpy()
        x = np.frombuffer(index.as_buffer(), {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(len(rows), d)
        out.append(Block(rows, ids, rows * 2 + null, x))
    return out, matrix(batch.column(4), d), matrix(batch.column(5), d)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block the sum over the terms of weight times maximum; never below a score of the block."""
    q, h, w = queries.astype(np.float64), high.astype(np.float64), low.astype(np.float64)
    total = np.maximum(q, 0) @ h.T + np.minimum(q, 0) @ w.T
    if q.shape[1] * largest(q) * max(largest(h), largest(w)) >= EXACT:  # not exact: leave room for the rounding
        total += 1e-12 * (np.abs(q) @ np.maximum(np.abs(h), np.abs(w)).T)
    return total


def search(tops: Tops, queries: np.ndarray, own: np.ndarray, held: list[Block], high: np.ndarray, low: np.ndarray) -> None:
    """Score the blocks for all queries, each query's in falling order of their bounds, in windows of 1, 1, 2, 4, ... blocks."""
    for start in range(0, len(queries), CHUNK):
        part = np.arange(start, min(start + CHUNK, len(queries)))
        bound = bounds(queries[part], high, low)
        order = np.argsort(-bound, axis=1, kind="stable")
        begin, size = 0, 1
        while begin < len(held):
            window = order[:, begin:begin + size]
            worth = np.take_along_axis(bound, window, 1) >= tops.cut[part][:, None]
            if not worth.any():
                break  # every later bound is lower still
            who, at = np.nonzero(worth)
            block = window[who, at]
            for b in np.unique(block):
                _score(tops, part[who[block == b]], queries, own, held[b])
            begin, size = begin + size, max(1, begin + size)


def _score(tops: Tops, who: np.ndarray, queries: np.ndarray, own: np.ndarray, block: Block) -> None:
    score = products(queries[who], block.x)
    other = own[who][:, None] != block.rows[None, :]
    least = tops.cut[who]
    if score.shape[1] > tops.k:
        ranked = np.where(other, score, LOWEST)
        least = np.maximum(least, np.partition(ranked, -tops.k, axis=1)[:, -tops.k])
    at, col = np.nonzero(other & (score >= least[:, None]))
    tops.add(who[at], score[at, col], block.ids[col], block.marks[col])


# ---------------------------------------------------------------- search on Spark

COLUMNS = ["rows", "ids", "width", "index", "high", "low"]


def _found(rows: DataFrame, d: int, k: int, slice_) -> DataFrame:
    """(row, query_id, score, id, mark): each task's best rows of the slice's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own, ids, start, homes = slice_.value
        tops = Tops(k, start)
        for batch in batches:
            held, high, low = _read(batch, d)
            if homes is None:
                search(tops, queries, own, held, high, low)
            else:
                for block, cluster in zip(held, batch.column(6).to_numpy()):
                    who = np.flatnonzero(homes == cluster)
                    for at in range(0, len(who), CHUNK):
                        _score(tops, who[at:at + CHUNK], queries, own, block)
        q, s, i, m = tops.found
        for at in range(0, len(q), 65_536):
            z = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[q[z]]), pa.array(ids[q[z]]), pa.array(s[z]), pa.array(i[z], mask=m[z] % 2 == 1), pa.array(m[z])],
                ["row", "query_id", "score", "id", "mark"],
            )

    return rows.mapInArrow(run, "row long, query_id long, score long, id long, mark long")


def _sliced(rows: DataFrame, number: int, of: int, d: int):
    """(vectors, rows, ids) of one slice of the queries: about ``AT_ONCE`` of them."""
    t = rows.filter(F.col("q") & (F.pmod(F.xxhash64("row"), F.lit(of)) == number)).select("row", "id", "x").toArrow()
    return matrix(t.column("x"), d), t.column("row").to_numpy(), t.column("id").to_numpy()


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row the k other rows of highest integer inner product.

    Vectors are floor(scale * x). Ties go to the smaller ``vec_id``, a null one last, then to the earlier row; with fewer
    than k other rows all are returned. ``is_query`` is a condition over the input's columns; a row without an id is no query.
    A vector that is null or holds null, NaN or an infinity takes no part. Shorter vectors are padded by zeros, an empty
    one scores 0. Rows that repeat an id are rows of their own: each is a query, and each a candidate of the other.
    Components or scores past the long range take its ends. Other columns play no part; no rows give no rows.
    """
    bare = usable(df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "v")
    rows = bare.select("id", scaled("v", scale).alias("x"), (F.col("q") & F.col("id").isNotNull()).alias("q"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "topk-rows")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d"), F.count_if("q").alias("m")).first()
    n, d, m = shape["n"], max(shape["d"], 1), shape["m"]
    centres = _clusters(rows, n, d)
    held = stored(blocks(rows, d, centres, n), "topk-index")
    slices, context, paths = -(-m // AT_ONCE), df.sparkSession.sparkContext, []
    for number in range(slices):
        queries, own, ids = _sliced(rows, number, slices, d)
        start, homes = np.full(len(own), LOWEST), nearest(queries.astype(np.float64), centres)
        first = _found(held.filter("first").select(*COLUMNS, "cluster"), d, k, context.broadcast((queries, own, ids, start, homes)))
        full = first.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        known = full.select("row", "least").toArrow()  # a number for each query of the slice
        at = {r: i for i, r in enumerate(own.tolist())}
        for r, least in zip(known.column("row").to_pylist(), known.column("least").to_pylist()):
            start[at[r]] = least
        paths.append(stored(_found(held.select(*COLUMNS), d, k, context.broadcast((queries, own, ids, start, None))), "topk-found"))
    found = paths[0] if paths else df.sparkSession.createDataFrame([], "row long, query_id long, score long, id long, mark long")
    for more in paths[1:]:
        found = found.unionByName(more)
    best = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "mark")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
