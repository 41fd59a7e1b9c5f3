"""Small helpers the operators of this package share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.session import configure, scratch_path

# the word rule of every operator here: white space is the six ASCII characters only
BLANKS = b" \t\n\r\x0b\x0c"
# rows of a batch that Python holds: texts may be long
BATCH_ROWS = 512


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this library's settings and batches of few rows."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def strings(column) -> list[str]:
    """The values of an Arrow text column; null reads as the empty text."""
    return [x or "" for x in column.to_pylist()]


def words_of(text: str) -> list[bytes]:
    """Words by the ASCII white-space rule, A-Z lower-cased. Bytes split and lower by ASCII alone."""
    return text.encode().lower().split()


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % divisor


def stored(df: DataFrame, name: str, rows_per_page: int | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage ends there, executors may be lost.

    A page of few rows keeps rows of megabytes from being compressed, and read, many at a time.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.option("parquet.page.row.count.limit", rows_per_page) if rows_per_page else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The shuffle width the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def grid_side(spark: SparkSession) -> int:
    """Side of the square grid whose cells fill the shuffle width."""
    return max(1, math.ceil(math.sqrt(width(spark))))
