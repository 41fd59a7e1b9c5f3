"""Quality rules: counts of the words and lines, and zstandard compression bands.

Repetition compresses too well, noise (keys, encoded bytes) too badly. How well clean prose compresses depends on
its length, so each length band has limits of its own. The whole text is judged by its band; then every fixed chunk
by the same table, because a repetitive half hides in the ratio of a long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, functions as F, types as T

from riskframe.llm.common import BLANKS, strings

# From so many bytes on, the ratio raw / compressed must lie within (low, high).
BANDS = [
    (0, 0.35, 1.60),
    (64, 0.55, 2.00),
    (128, 0.75, 2.60),
    (256, 0.95, 2.60),
    (512, 1.10, 2.60),
    (1024, 1.20, 2.70),
    (2048, 1.30, 2.80),
    (4096, 1.40, 2.90),
    (8192, 1.45, 3.00),
    (16384, 1.50, 3.30),
]
SYMBOLS = b"#*$%&|<>"
CHUNK = 4096
BAD_CHUNK_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PCT = 50

SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("n_chunks", T.LongType()),
    T.StructField("n_bad_chunks", T.LongType()),
    T.StructField("kept", T.BooleanType()),
])


def repeated_words(words: list[bytes]) -> int:
    """Words lying in a window of three words that the text holds at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:  # else three ids fit one integer
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.encode().strip(BLANKS)]
    return len(lines) - len(set(lines))


def in_band(size: int, ratio: float) -> bool:
    low, high = next((lo, hi) for start, lo, hi in reversed(BANDS) if size >= start)
    return low <= ratio <= high


def compression(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, chunks judged, chunks out of their band, verdict. A last piece under a quarter chunk is not judged."""
    if not data:
        return 0.0, 0, 0, True
    ratio = len(data) / len(packer.compress(data))
    chunks = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)] if len(data) > CHUNK else []
    chunks = [c for c in chunks if 4 * len(c) >= CHUNK]
    bad = sum(not in_band(len(c), len(c) / len(packer.compress(c))) for c in chunks)
    good = in_band(len(data), ratio) and (not chunks or bad < BAD_CHUNK_SHARE * len(chunks))
    return ratio, len(chunks), bad, good


def judge(text: str, packer: zstandard.ZstdCompressor) -> tuple:
    data = text.encode()
    words = data.split()
    inked = len(data.translate(None, BLANKS))
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * len(words)
    ratio, chunks, bad, good = compression(data, packer)
    return (
        len(words), len(text) - (len(data) - inked), len(data) - len(data.translate(None, SYMBOLS)),
        duplicate_lines(text), repeats, failed, ratio, chunks, bad, good and not failed,
    )


@F.arrow_udf(SCHEMA)
def _rules(texts: pa.Array) -> pa.Array:
    packer = zstandard.ZstdCompressor(level=3)
    rows = list(zip(*[judge(x, packer) for x in strings(texts)])) or [()] * len(SCHEMA)
    kinds = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}
    return pa.StructArray.from_arrays(
        [pa.array(r, kinds[type(f.dataType)]) for r, f in zip(rows, SCHEMA)], names=SCHEMA.names
    )


# not to be evaluated once for a filter and again for the columns
_rules = _rules.asNondeterministic()


def quality(text: str | Column) -> Column:
    """One struct of ``SCHEMA`` per text.

    A null or empty text has no words: all counts 0, ratio 0, ``base_failed`` true and ``kept`` false. Texts of any
    length are judged whole. Each row is judged alone, so repeated rows get equal results, an empty table gives an
    empty result and other columns play no part.
    """
    return _rules(F.col(text) if isinstance(text, str) else text)
