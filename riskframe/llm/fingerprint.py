"""Document fingerprints: threshold-scaled sketches of character shingles.

A sketch retains every shingle hash below a fixed fraction of the hash range, so its size grows with the text. The
sketches of two texts select the same shingles wherever the texts agree: the union of two sketches is the sketch of
the joined shingle sets, and the share of one in the other estimates containment however unequal the texts are.

``next_rows`` gives every row the row that follows it in a global order without a global window: rows are cut into
ranges of the key, sorted, and read once in order; the first row of each range also travels, as a guest, to the end
of the range before it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.llm.common import strings, width

SHINGLE = 16  # bytes of UTF-8
SCALE = 16  # one hash in so many is retained
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return (x ^ (x >> _SHIFT)) * _MIX


def sketch(text: str, scale: int = SCALE) -> np.ndarray:
    """The retained hashes, sorted, as unsigned 32-bit values.

    A text shorter than a shingle is one shingle by itself. A text with shingles retains at least its smallest hash,
    so that only the empty text has an empty sketch.
    """
    data = text.encode()
    if not data:
        return np.zeros(0, np.uint32)
    n = max(1, len(data) - SHINGLE + 1)
    buffer = data.ljust(SHINGLE, b"\0")
    low = np.ndarray((n,), "<u8", buffer, 0, (1,))
    high = np.ndarray((n,), "<u8", buffer, 8, (1,))
    hashes = _mixed(low * _MULTIPLY + _mixed(high + _MULTIPLY)) >> _SHIFT
    kept = hashes[hashes < (1 << 32) // scale]
    return np.unique(kept if len(kept) else hashes.min(keepdims=True)).astype(np.uint32)


def as_text(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits per hash, in order."""
    return hashes.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Jaccard estimate, share of a in b, share of b in a. Two empty sketches are alike; an empty one is in any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b)), float(not len(a)), float(not len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / len(a), both / len(b)


@F.arrow_udf(T.StringType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([as_text(sketch(x)) for x in strings(texts)], pa.string())


def fingerprint(text: str | Column) -> Column:
    """The sketch of every text as a string; null reads as empty and has the empty string."""
    return _fingerprint(F.col(text) if isinstance(text, str) else text)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(strings(a), strings(b))
    return pa.array([likeness(from_text(x), from_text(y)) for x, y in pairs], pa.list_(pa.float64()))


def alike(a: str, b: str) -> Column:
    """Jaccard estimate, share of a in b, share of b in a, of two fingerprint strings; null reads as empty."""
    return _alike(F.col(a), F.col(b))


def _places(cuts: list[int], guests: dict[int, int]):
    """The range of a key, and as -1 - range the one that its row also visits as a guest."""

    @F.arrow_udf("array<int>")
    def place(keys: pa.Array) -> pa.Array:
        out = []
        for k in keys.to_pylist():
            r = 0 if k is None else bisect_right(cuts, k)
            out.append([r, -1 - guests[k]] if k in guests else [r])
        return pa.array(out, pa.list_(pa.int32()))

    return place


def next_rows(rows: DataFrame, key: str, tie: str, each: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """``each(row, next row)`` for all rows in ascending (key, tie) order; after the last row comes the first.

    ``key`` is an integer column, null comes first. Rows equal in key and tie may stand in either order. ``each`` gets
    two dicts and returns one of the fields of ``schema``. A single row is its own next; no rows give no rows.
    """
    n = width(rows.sparkSession)
    keys = rows.select(F.col(key).cast("long").alias("k"))
    cuts = []
    if n > 1:
        ends = keys.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n).alias("x")).first()["x"]
        cuts = sorted(set(ends or []))
    where = _places(cuts, {})
    first = keys.groupBy(where("k")[0].alias("r")).agg(F.min("k").alias("k"), F.count_if(F.col("k").isNull()).alias("nulls")).collect()
    heads = sorted((r["r"], None if r["nulls"] else r["k"]) for r in first)
    guests = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}

    fields = [f for f in rows.columns]
    names = [x.split()[0] for x in schema.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pending = None, None
        kinds = {f.name: f.type for f in to_arrow_schema(out_schema)}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["range_"] != current:
                    current, pending = row["range_"], None
                if pending is not None:
                    out.append(each(pending, row))
                pending = None if row["guest_"] else row
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in names], names)

    out_schema = T.StructType.fromDDL(schema)
    at = F.explode(_places(cuts, guests)(F.col(key).cast("long")))
    return (
        rows.select(*fields, at.alias("at_"))
        .select(*fields, F.when(F.col("at_") < 0, -1 - F.col("at_")).otherwise(F.col("at_")).alias("range_"), (F.col("at_") < 0).alias("guest_"))
        .repartitionByRange(n, "range_")
        .sortWithinPartitions("range_", "guest_", F.col(key).asc_nulls_first(), tie)
        .mapInArrow(walk, schema)
    )


def edited_text(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the beginning of the following one."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def compare_with_edit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the
    containments in_edited and in_next (share of the document's sketch found there). A null text is empty; two empty
    texts are alike (1), an empty and another text are not (0). Equal ids are ordered by a hash of the text; equal
    rows are each other's next. Other columns play no part; no documents give no rows.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    def each(row: dict, following: dict) -> dict:
        edited = edited_text(row["text"], following["text"])
        if "sketch" not in row:
            row["sketch"] = sketch(row["text"], scale)
        following["sketch"] = sketch(following["text"], scale)
        changed = sketch(edited, scale)
        near_edited, in_edited, _ = likeness(row["sketch"], changed)
        near_next, in_next, _ = likeness(row["sketch"], following["sketch"])
        return {
            "doc_id": row["doc_id"], "n_chars": len(row["text"]), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
            "fingerprint": as_text(row["sketch"]), "edited_fingerprint": as_text(changed),
            "near_edited": near_edited, "near_next": near_next, "in_edited": in_edited, "in_next": in_next,
        }

    return next_rows(
        rows, "doc_id", "tie", each,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, in_edited double, in_next double",
    ).withColumnRenamed("doc_id", doc_id)
