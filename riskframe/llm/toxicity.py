"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed byte n-gram (3 to 6 bytes of the lower-cased text, padded by a blank) in the
whole text. Spark counts, per n-gram, the toxic and the clean training texts that hold it; the smoothed log ratio of
the two rates is the feature's scale. N-grams with a small ratio are left out, and a ridge-penalised logistic
regression on the rest gives the weights. Both tables have at most ``1 << BITS`` entries whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import remainder, stored, strings

BITS = 20
SIZES = (3, 4, 5, 6)
SMOOTHING = 5.0  # texts added to both rates of a feature, in proportion to the classes
LEAST_RATIO = 2.0
LEAST_TEXTS = 3
SAMPLE = 6000  # labelled texts to learn from, at most
STEPS, RATE = 150, 0.05
BLOCK = 1 << 20  # positions hashed at once
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def features(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct feature numbers of a text, only those with a true flag in ``wanted`` if it is given."""
    data = b" " + text.encode().lower() + b" "
    windows = np.ndarray((len(data),), "<u8", data + bytes(8), 0, (1,))
    found = []
    for n in SIZES:
        last = len(data) - n + 1
        for start in range(0, max(0, last), BLOCK):
            x = windows[start:min(last, start + BLOCK)] & np.uint64((1 << (8 * n)) - 1)
            at = (((x * _A + np.uint64(n)) * _B) >> np.uint64(64 - BITS)).astype(np.int32)
            found.append(np.unique(at) if wanted is None else at[wanted[at]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Classifier:
    index: np.ndarray  # features with a weight
    weight: np.ndarray  # of each: ratio times coefficient
    bias: float

    def flags(self) -> np.ndarray:
        wanted = np.zeros(1 << BITS, bool)
        wanted[self.index] = True
        return wanted

    def table(self) -> np.ndarray:
        weights = np.zeros(1 << BITS)
        weights[self.index] = self.weight
        return weights


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(column: np.ndarray, row: np.ndarray, scale: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge-penalised coefficients of sparse features (entry i: row[i], column[i], value scale[column[i]]) and the bias."""
    n, x = len(label), scale[column]
    w, b = np.zeros(len(scale)), float(np.log((label.sum() + 0.5) / (n - label.sum() + 0.5)))
    mean, spread, mean_b, spread_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        error = (_sigmoid(np.bincount(row, x * w[column], n) + b) - label) / n
        slope, slope_b = np.bincount(column, x * error[row], len(w)) + w / n, error.sum()
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope * slope
        mean_b, spread_b = 0.9 * mean_b + 0.1 * slope_b, 0.99 * spread_b + 0.01 * slope_b * slope_b
        up, down = 1 - 0.9 ** step, 1 - 0.99 ** step
        w = w - RATE * (mean / up) / (np.sqrt(spread / down) + 1e-8)
        b = b - RATE * (mean_b / up) / (np.sqrt(spread_b / down) + 1e-8)
    return w, float(b)


def fit(texts: DataFrame, text: str = "text", label: str = "label", sample: int = SAMPLE) -> Classifier:
    """Learn from the rows of a frame of texts and labels (1 toxic, 0 clean; rows with another label are left out).

    At most ``sample`` rows are used, the first by a hash of the text and label, so the choice does not depend on
    the order of the rows. Counting runs on Spark; the regression runs on the sample's selected features. Without
    rows of both labels no feature is selected and the bias alone is the (smoothed) class rate.
    """
    rows = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    rows = stored(rows.orderBy(F.xxhash64("text", "label"), "text", "label").limit(sample), "toxicity-sample")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    n, n1 = sizes["n"], sizes["n1"]
    n0 = n - n1
    if not n1 or not n0:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                both[y][features(t)] += 1
        at = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(both[0][at]), pa.array(both[1][at])], ["f", "c0", "c1"])

    def rate(c, size):
        return (F.sum(c) + SMOOTHING * size / n) / (size + 2 * SMOOTHING * size / n)

    chosen = (
        rows.mapInArrow(count, "f int, c0 int, c1 int").groupBy("f")
        .agg(F.log(rate("c1", n1) / rate("c0", n0)).alias("ratio"), F.sum(F.col("c0") + F.col("c1")).alias("texts"))
        .filter((F.abs("ratio") >= LEAST_RATIO) & (F.col("texts") >= LEAST_TEXTS)).select("f", "ratio").toPandas().sort_values("f")
    )
    index, ratio = chosen["f"].to_numpy(np.int64), chosen["ratio"].to_numpy(np.float64)
    flags = Classifier(index, ratio, 0.0).flags()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, flags) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["label", "f"])

    picked = rows.mapInArrow(pick, "label int, f array<int>").toArrow()  # at most ``sample`` rows of selected features
    label_of = picked["label"].to_numpy().astype(np.float64)
    held = [np.asarray(x, np.int64) for x in picked["f"].to_pylist()]
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    column = np.searchsorted(index, np.concatenate(held)) if len(row) else np.zeros(0, np.int64)
    coefficient, bias = logistic(column, row, ratio, label_of)
    return Classifier(index, ratio * coefficient, bias)


def toxicity(model: Classifier, text: str | Column) -> Column:
    """Probability that the label is 1, from the whole text. A null or empty text scores by the bias alone.

    Rows are scored one by one: repeated rows score alike and other columns play no part.
    """
    index, weight, bias = model.index, model.weight, model.bias

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        here = Classifier(index, weight, bias)
        flags, table = here.flags(), here.table()
        for texts in batches:
            sums = np.array([table[features(x, flags)].sum() if x else 0.0 for x in strings(texts)])
            yield pa.array(_sigmoid(sums + bias), pa.float64())

    return score(F.col(text) if isinstance(text, str) else text)


def learn_from_labels(
    docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE,
) -> Classifier:
    """``fit`` on the documents that ``labels`` marks and ``usable`` (over the labels) admits.

    An id labelled twice alike counts once, an id with both labels is left out. The sample is drawn from the ids, by
    hash, before any text is read; its size bounds the broadcast.
    """
    marks = (
        labels.filter(usable).filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id_"))
        .agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other")
        .orderBy(F.xxhash64(F.col("id_").cast("string")), "id_").limit(sample).select("id_", "label")
    )
    texts = docs.select(F.col(doc_id).alias("id_"), F.col(text).alias("text")).join(F.broadcast(marks), "id_")
    return fit(texts, "text", "label", sample)


def held_out(doc_id: str, divisor: int) -> Column:
    """True for the ids whose crc32 leaves 1; a null id is not held out."""
    return F.coalesce(remainder(doc_id, divisor) == 1, F.lit(False))
