"""Raw readers and the write-once layer sink."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskframe.functions.parsing import clean
from riskframe.operators.quality import QualityError, run_gate


def read_raw_csv(
    spark: SparkSession, path: str, columns: list[str], ingested_at: datetime,
    partitions: int | None = None, multi_line: bool | None = None,
) -> DataFrame:
    """All-text rows of (gzipped) CSV files with their lineage, blank rows dropped.

    A gzip file is read by one task; ``partitions`` spreads its rows for the
    work that follows. NULL is the empty field. Fields may hold line breaks if
    ``multi_line`` says so. By default they may, unless the path names one plain
    ``.csv`` file without a line whose quotes stay open: it is split. If
    ``multi_line`` is off, such a line is an error.
    """
    if multi_line is False or multi_line is None and path.endswith(".csv"):
        torn = not spark.read.text(path).filter(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()
        if torn and multi_line is False:
            raise ValueError(f"{path} has fields with line breaks: read it with multi_line")
        multi_line = torn
    multi_line = True if multi_line is None else multi_line
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
        .select("*", F.col("_metadata.file_name").alias("source_file"))
        .na.drop("all", subset=columns)
        .withColumn("ingested_at", F.lit(ingested_at.isoformat()))
    )
    return raw.repartition(partitions) if partitions else raw


def read_numeric(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a Parquet table as doubles; the scan reads nothing else.

    Repeated names are read once, an unknown name is an error, flags become
    0/1, missing stays NULL and NaN becomes NULL.
    """
    table = spark.read.parquet(path)
    names = list(dict.fromkeys(columns))
    unknown = [c for c in names if c not in table.columns]
    if unknown:
        raise ValueError(f"columns not in {path}: {', '.join(unknown)}")
    return table.select(*[clean(F.col(c)).alias(c) for c in names])


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def is_complete(spark: SparkSession, path: str) -> bool:
    """A layer exists once its writer has left the success marker."""
    fs, target = _filesystem(spark, f"{path}/_SUCCESS")
    return fs.exists(target)


def write_once(df: DataFrame, path: str, partition_by: list[str] = ()) -> bool:
    """Write a layer unless a complete one is there; returns whether it wrote.

    What a failed job left behind carries no marker and is replaced.
    """
    if is_complete(df.sparkSession, path):
        return False
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return True


def write_checked(
    df: DataFrame, path: str, checks, layer: str, strict: bool = False, partition_by: list[str] = ()
) -> bool:
    """Write a layer once and mark it complete only after its checks.

    The rows are computed once, into a directory of another name; the checks
    read its columns. Only then is it renamed, so nothing stands under ``path``
    before the checks; a strict failure removes it. ``checks`` is one suite or a list of (name,
    filter, suite).
    """
    spark = df.sparkSession
    if is_complete(spark, path):
        return False
    aside = f"{path.rstrip('/')}.unchecked"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(aside)
    stored = spark.read.parquet(aside)
    suites = checks if isinstance(checks, list) else [(layer, None, checks)]
    try:
        for name, condition, suite in suites:
            run_gate(stored if condition is None else stored.where(condition), suite, name, strict)
    except QualityError:
        remove_directory(spark, aside)
        raise
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)  # what a failed job left behind; a complete layer has returned above
    if not fs.rename(_filesystem(spark, aside)[1], target):
        raise OSError(f"cannot rename {aside} to {path}")
    return True


def remove_directory(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.delete(target, True)


def list_partitions(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column, read from the directory names."""
    fs, target = _filesystem(spark, path)
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    prefix = f"{column}="
    return sorted(n[len(prefix):] for n in names if n.startswith(prefix))
