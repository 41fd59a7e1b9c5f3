"""Live counters over the decision stream.

Every function takes a batch or a streaming frame. The event time is a
TIMESTAMP; wall-clock columns are cast at the source.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.functions.literals import sql_double, sql_doubles
from riskframe.sources.versions import VersionedTable


WINDOW = "5 minutes"
LATENESS = "10 minutes"

# Upper bounds of the score buckets 0, 0.05, ... 0.95.
SCORE_BOUNDS = [i * 0.05 for i in range(20)]
# Upper bounds of the latency buckets in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def event_stream(
    spark: SparkSession, folder: str, files: str = "*.parquet", ts: str = "ts", per_trigger: int | None = None
) -> DataFrame:
    """A stream over the Parquet files of a folder whose event time may be stored without a zone."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def _window(ts: str, window: str, slide: str | None):
    return F.window(ts, window, slide) if slide else F.window(ts, window)


def windowed_counts(
    events: DataFrame, keys: list[str], ts: str = "ts", window: str = WINDOW, slide: str | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Count and per-second rate of each key combination per event-time window."""
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return (
        events.withWatermark(ts, lateness)
        .groupBy(_window(ts, window, slide).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
            "count", (F.col("count") / seconds).alias("rate"),
        )
    )


def bucket_counts(
    events: DataFrame, value: str, bounds: list[float], keys: list[str] = (), ts: str = "ts",
    window: str = WINDOW, slide: str | None = None, lateness: str = LATENESS,
) -> DataFrame:
    """One row per window and key with ``counts``: rows per right-closed bucket, +Inf last.

    The buckets are plain sums, so the stream state is one fixed-width row per
    window and key.
    """
    v = F.col(value)
    edges = [None, *bounds]
    inside = [
        ((v <= b) if a is None else (v > a) & (v <= b)) for a, b in zip(edges, bounds)
    ] + [v > bounds[-1]]
    counts = [F.count_if(c).alias(f"b{i}") for i, c in enumerate(inside)]
    return (
        events.where(v.isNotNull())
        .withWatermark(ts, lateness)
        .groupBy(_window(ts, window, slide).alias("w"), *keys)
        .agg(*counts)
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
            F.array(*[F.col(f"b{i}") for i in range(len(inside))]).alias("counts"),
        )
    )


def bucket_quantile(counts: str, bounds: list[float], q: float):
    """Linear interpolation inside the bucket that holds the q-th observation.

    The first bucket starts at 0 if its bound is positive; a rank in the +Inf
    bucket gives the largest finite bound.
    """
    limits = sql_doubles(bounds)
    upto = f"aggregate(slice({counts}, 1, i + 1), 0L, (s, c) -> s + c)"
    before = f"aggregate(slice({counts}, 1, i), 0L, (s, c) -> s + c)"
    total = f"aggregate({counts}, 0L, (s, c) -> s + c)"
    rank = f"({sql_double(q)} * {total})"
    found = f"element_at(filter(sequence(0, size({counts}) - 1), i -> {upto} >= {rank}), 1)"
    low = f"case when i = 0 then 0D else get({limits}, i - 1) end"
    at_first = f"(i = 0 and get({limits}, 0) <= 0)"
    value = (
        f"case when i >= {len(bounds)} then {sql_double(bounds[-1])} "
        f"when {at_first} then get({limits}, 0) "
        f"else {low} + (get({limits}, i) - {low}) * ({rank} - {before}) / get({counts}, i) end"
    )
    return F.expr(f"case when {total} > 0 then element_at(transform(array({found}), i -> {value}), 1) end")


def score_quantiles(events: DataFrame, score: str, ts: str = "ts", **window) -> DataFrame:
    """p50 and p90 of the score per window from bucket counts."""
    return bucket_counts(events, score, SCORE_BOUNDS, ts=ts, **window).select(
        "window_start", "window_end", "counts",
        bucket_quantile("counts", SCORE_BOUNDS, 0.5).alias("p50"),
        bucket_quantile("counts", SCORE_BOUNDS, 0.9).alias("p90"),
    )


def latency_quantiles(events: DataFrame, seconds: str, endpoint: str, ts: str = "ts", q: float = 0.95, **window) -> DataFrame:
    """p95 latency per endpoint and window from bucket counts."""
    return bucket_counts(events, seconds, LATENCY_BOUNDS, [endpoint], ts=ts, **window).select(
        "window_start", "window_end", endpoint,
        bucket_quantile("counts", LATENCY_BOUNDS, q).alias("p95"),
    )


def start_append(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished windows to a Parquet table."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_scoring(requests: DataFrame, score, log_path: str, checkpoint: str, ts: str = "ts",
                  lateness: str = LATENESS, available_now: bool = True) -> StreamingQuery:
    """Score a request stream and append each micro-batch to the decision log once.

    ``score`` turns a batch of requests into decision envelopes. A replayed
    batch finds its number under ``log_path`` and overwrites exactly that part.
    The rows of a batch are kept while the scoring reads them several times; a
    batch without rows, as one that only moves the watermark, is not scored.
    """
    unique = requests.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["request_id"])

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            if not rows.isEmpty():
                score(rows).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
                    f"{log_path}/batch={number}"
                )
        finally:
            rows.unpersist()

    writer = unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def request_log(spark: SparkSession, path: str) -> VersionedTable:
    """Where a scored stream writes: results and errors, one partition per kind and day of the event time."""
    return VersionedTable(spark, path, "part")


def start_request_log(
    requests: DataFrame, score, table: VersionedTable, checkpoint: str, ts: str = "ts", lateness_minutes: int = 10,
    available_now: bool = True, writer: str = "stream",
) -> StreamingQuery:
    """Score a request stream into a log in which every request shows: decided, failed, late, repeated or without a time.

    A request is late if its event time lies more than the lateness before the latest one of the earlier micro-batches, and
    repeated if its id was accepted with an event time at most that much before its own, in this micro-batch or an earlier
    one; older ids are forgotten. Of equal ids in a micro-batch the earliest is accepted. Such rows have ``error`` late,
    repeated or no_time, and ``repeats`` says how many there were; ``score`` turns the others into envelopes with
    ``request_id`` and ``error``. Results, errors and the latest event time are committed together under the number of the
    micro-batch: one that runs again after a crash finds its number and changes nothing. Of the log only the days within the
    lateness are read.
    """
    lateness = lateness_minutes * 60 * 1_000_000

    def write(batch: DataFrame, number: int) -> None:
        base = table.manifest()
        if number <= base.batches.get(writer, -1):
            return
        floor = int(base.notes[writer]) if writer in base.notes else None
        at = F.unix_micros(F.col(ts))
        rows = batch.groupBy(*batch.columns).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__at", at).persist()
        placed = None
        try:
            bounds = rows.agg(F.min("__at").alias("low"), F.max("__at").alias("high")).first()
            late = F.lit(False) if floor is None else F.col("__at") < floor - lateness
            marked = rows.withColumn("__wrong", F.when(F.col("__at").isNull(), "no_time").when(late, "late"))
            if floor is not None and bounds["low"] is not None:
                since = datetime.fromtimestamp((max(bounds["low"], floor - lateness) - lateness) / 1e6, timezone.utc).date().isoformat()
                days = [p for p in base.parts if p.rsplit(" ", 1)[-1] >= since]
                known = table.read(days, base.number).where("error is null or error not in ('late', 'repeated', 'no_time')")
                known = known.groupBy("request_id").agg(F.max(F.unix_micros("event_at")).alias("__known"))
                marked = marked.join(known, "request_id", "left")
                again = F.col("__wrong").isNull() & (F.col("__known") >= F.col("__at") - lateness)
                marked = marked.withColumn("__wrong", F.when(again, "repeated").otherwise(F.col("__wrong"))).drop("__known")
            order = F.struct("__at", F.xxhash64(*batch.columns))
            fresh = marked.where("__wrong is null")
            firsts = fresh.groupBy("request_id").agg(F.min(order).alias("__first"))
            placed = marked.join(firsts, "request_id", "left").withColumn("__accepted", F.col("__wrong").isNull() & (order == F.col("__first")))
            placed = placed.persist()  # the scoring reads the accepted rows several times
            accepted = placed.where("__accepted")
            refused = placed.withColumn("repeats", F.col("__copies") - F.col("__accepted").cast("long")).where("repeats > 0").groupBy(
                "request_id", F.col(ts).alias("event_at"), F.coalesce("__wrong", F.lit("repeated")).alias("error")
            ).agg(F.sum("repeats").alias("repeats"))
            times = accepted.select(F.col("request_id").alias("__id"), F.col(ts).alias("event_at"))
            done = score(accepted.select(*batch.columns))
            done = done.join(times, F.col("request_id").eqNullSafe(F.col("__id"))).drop("__id").withColumn("repeats", F.lit(0).cast("long"))
            out = done.unionByName(refused, allowMissingColumns=True)
            kind = F.when(F.col("error").isNull(), F.lit("results ")).otherwise(F.lit("errors "))
            part = F.concat(kind, F.coalesce(F.date_format("event_at", "yyyy-MM-dd"), F.lit("0000-00-00")))
            latest = max((x for x in (floor, bounds["high"]) if x is not None), default=None)
            table.append(out.withColumn("part", part), writer, number, None if latest is None else str(latest))
        finally:
            if placed is not None:
                placed.unpersist()
            rows.unpersist()

    query = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def window_drift(histograms: DataFrame, training: DataFrame) -> DataFrame:
    """PSI of each window's ten-bin score histogram against the training histogram.

    ``histograms`` has ``counts`` (array of bins), ``training`` one row with
    ``bin_counts``; both are smoothed by one per bin.
    """
    expected = training.select("bin_counts").scalar()
    total = "aggregate({0}, 0L, (s, c) -> s + c) + size({0})"
    return histograms.withColumn("expected", expected).selectExpr(
        "window_start",
        "window_end",
        "aggregate(counts, 0L, (s, c) -> s + c) as n",
        f"""aggregate(zip_with(counts, expected,
              (a, e) -> ((a + 1) / ({total.format('counts')}) - (e + 1) / ({total.format('expected')}))
                        * ln(((a + 1) / ({total.format('counts')})) / ((e + 1) / ({total.format('expected')})))),
              double(0), (s, x) -> s + x) as psi""",
    )


def start_drift(events: DataFrame, score: str, training: DataFrame, path: str, checkpoint: str,
                window: str = "1 day", ts: str = "ts", available_now: bool = True) -> StreamingQuery:
    """Follow the score shift of finished windows against the stored training histogram."""
    v = F.col(score)
    edges = [i / 10 for i in range(11)]
    counts = [
        F.count_if((v >= a) & ((v <= b) if i == 9 else (v < b))).alias(f"b{i}")
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    histograms = (
        events.withWatermark(ts, LATENESS)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(*counts)
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            F.array(*[F.col(f"b{i}") for i in range(10)]).alias("counts"),
        )
    )

    def write(batch: DataFrame, number: int) -> None:
        window_drift(batch, training).write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).parquet(f"{path}/batch={number}")

    writer = histograms.writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
