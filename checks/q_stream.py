"""Streams over the events table, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q, views as V
from riskframe.functions.numeric import round_away
from checks.q_model import M14_PARTS
from checks.registry import query, rounded, stamp
from riskframe.functions.scorecard import decision
from riskframe.operators import trees as T
from riskframe.plans.scoring import score_requests
from riskframe.session import scratch_path
from riskframe.sources.feature_store import training_distribution
from riskframe.streaming import decisions as ST

# a window is final once the latest event is further on than the lateness
CLOSED = "w + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


def text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def decided(spark, d):
    """The event stream as decisions with a score."""
    score = F.least(F.col("value") / 500, F.lit(1.0))
    return ST.event_stream(spark, d, "events.parquet").withColumns(
        {"score": score, "decision": decision(score), "request_id": F.col("event_id").cast("string")})


def run(spark, rows, name):
    path, checkpoint = scratch_path(spark, f"stream-{name}"), scratch_path(spark, f"offsets-{name}")
    ST.start_append(rows, path, checkpoint).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


DECIDED = {"decided": f"SELECT ts, least(value / 500, 1) AS score, {Q.decision('least(value / 500, 1)')} AS decision, event_type, value FROM events"}


@query("st1_decisions_tumbling", Q.build([], f"""
SELECT {text('w')} AS window_start, decision, n AS count, {r('n / 300.0::DOUBLE')} AS rate FROM
  (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, decision, count(*) AS n FROM decided GROUP BY 1, 2) WHERE {CLOSED}""", DECIDED))
def tumbling(spark, d):
    done = run(spark, ST.windowed_counts(decided(spark, d), ["decision"]), "tumbling")
    return rounded(done.select(stamp("window_start"), "decision", "count", "rate"))


@query("st1_decisions_sliding", Q.build([], f"""
SELECT {text('w')} AS window_start, decision, n AS count, {r('n / 300.0::DOUBLE')} AS rate FROM
  (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(k AS INTEGER)) AS w, decision, count(*) AS n FROM decided, range(5) s(k) GROUP BY 1, 2) WHERE {CLOSED}""", DECIDED))
def sliding(spark, d):
    done = run(spark, ST.windowed_counts(decided(spark, d), ["decision"], slide="1 minute"), "sliding")
    return rounded(done.select(stamp("window_start"), "decision", "count", "rate"))


def bucket_sql(value: str, bounds: list[float], keys: str, q: dict[str, float], width: str, closed: str) -> str:
    """Windowed bucket counts and quantiles interpolated inside the bucket."""
    lead = f"{keys}, " if keys else ""
    limits = ", ".join(f"({i}, {b!r}::DOUBLE)" for i, b in enumerate(bounds))
    index = " + ".join(f"CAST({value} > {b!r}::DOUBLE AS INTEGER)" for b in bounds)
    picks = ", ".join(
        f"""max(CASE WHEN upto >= {p} * total AND before < {p} * total OR (before = 0 AND {p} * total <= upto AND i = first) THEN
  CASE WHEN i = {len(bounds)} THEN {bounds[-1]!r} WHEN i = 0 AND x <= 0 THEN x ELSE coalesce(lo, 0) + (x - coalesce(lo, 0)) * ({p} * total - before) / c END END) AS {name}"""
        for name, p in q.items())
    return f"""
WITH {', '.join(f'{k} AS ({v})' for k, v in DECIDED.items())},
limits(i, x) AS (VALUES {limits}),
counted AS (SELECT time_bucket(INTERVAL {width}, ts) AS w, {lead}({index}) AS i, count(*) AS c FROM decided WHERE {value} IS NOT NULL GROUP BY ALL),
running AS (SELECT *, sum(c) OVER (PARTITION BY {lead}w ORDER BY i) AS upto, sum(c) OVER (PARTITION BY {lead}w ORDER BY i) - c AS before,
  sum(c) OVER (PARTITION BY {lead}w) AS total, min(i) OVER (PARTITION BY {lead}w) AS first FROM counted)
SELECT {text('w')} AS window_start, {lead}{', '.join(f'round({n}, 9) AS {n}' for n in q)} FROM (
  SELECT w, {lead}{picks} FROM (SELECT r.*, l.x, m.x AS lo FROM running r LEFT JOIN limits l ON l.i = r.i LEFT JOIN limits m ON m.i = r.i - 1) GROUP BY {lead}w)
WHERE {closed}"""


@query("st2_score_quantiles", bucket_sql("score", ST.SCORE_BOUNDS, "", {"p50": 0.5, "p90": 0.9}, "1 HOUR",
       "w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"))
def score_quantiles(spark, d):
    done = run(spark, ST.score_quantiles(decided(spark, d), "score", window="1 hour"), "scores")
    return rounded(done.select(stamp("window_start"), "p50", "p90"), 9)


@query("st3_requests_by_status", Q.build([], f"""
SELECT {text('w')} AS window_start, event_type AS status, n AS count, {r('n / 300.0::DOUBLE')} AS rate FROM
  (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, event_type, count(*) AS n FROM decided GROUP BY 1, 2) WHERE {CLOSED}""", DECIDED))
def by_status(spark, d):
    rows = decided(spark, d).withColumnRenamed("event_type", "status")
    done = run(spark, ST.windowed_counts(rows, ["status"]), "status")
    return rounded(done.select(stamp("window_start"), "status", "count", "rate"))


@query("st3_latency_p95", bucket_sql("value / 100", ST.LATENCY_BOUNDS, "event_type", {"p95": 0.95}, "1 DAY",
       "w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE").replace("event_type, round", "event_type AS endpoint, round"))
def latency(spark, d):
    rows = decided(spark, d).withColumn("seconds", F.col("value") / 100).withColumnRenamed("event_type", "endpoint")
    done = run(spark, ST.latency_quantiles(rows, "seconds", "endpoint", window="1 day"), "latency")
    return rounded(done.select(stamp("window_start"), "endpoint", "p95"), 9)


@query("st4_scored_stream", Q.build(["feature_store"], f"""
SELECT request_id, applicant_id, error, CASE WHEN error IS NULL THEN round(s, 5) END AS score, CASE WHEN error IS NULL THEN {Q.points('pd')} END AS scaled_score,
  CASE WHEN error IS NULL THEN {Q.decision('pd')} END AS decision FROM graded""", {
    "requests": "SELECT event_id::VARCHAR AS request_id, 'LC_' || user_id::VARCHAR AS applicant_id FROM events", **M14_PARTS}))
def scored_stream(spark, d):
    """Every request of the stream as a decision envelope, or as an error with its name."""
    store = V.feature_store(spark, d)
    model = T.load_ensemble(T.node_covers(V.gold(spark, d), V.tree_nodes(spark)), V.BASELINE)

    def score(batch):
        asked = batch.withColumn("applicant_id", F.concat(F.lit("LC_"), F.col("user_id").cast("string"))).select("request_id", "applicant_id")
        return score_requests(asked, store, model, V.CALIBRATOR, V.now(), V.MODEL_VERSION, 1)

    path, checkpoint = scratch_path(spark, "stream-scored"), scratch_path(spark, "offsets-scored")
    requests = decided(spark, d).select("request_id", "user_id", "ts")
    ST.start_scoring(requests, score, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("request_id", "applicant_id", "error", "score", "scaled_score", "decision")


# requests in three files by time; every seventh comes a file late, every fifth twice
ARRIVED = {
    "timed": "SELECT event_id, user_id, ts, least(2, floor(3 * (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events))) AS third FROM events",
    "arrived": """SELECT *, CAST(third AS INTEGER) + CAST(event_id % 7 = 0 AS INTEGER) AS file FROM timed
  UNION ALL SELECT *, CAST(third AS INTEGER) FROM timed WHERE event_id % 5 = 0 AND event_id % 7 <> 0""",
    "floors": "SELECT file, max(max(ts)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM arrived GROUP BY file",
    "judged": """SELECT event_id, user_id, file, count(*) AS copies, coalesce(min(ts) < max(latest) - INTERVAL 10 MINUTE, false) AS late
  FROM arrived JOIN floors USING (file) GROUP BY event_id, user_id, file""",
    "requests": "SELECT event_id::VARCHAR AS request_id, 'LC_' || user_id::VARCHAR AS applicant_id FROM judged WHERE NOT late",
}


def arrival_parts(events: int) -> int:
    """Files of one arrival: every micro-batch takes as many, and each has rows for all of them."""
    return max(1, events // 500_000)


@query("st4_request_log", Q.build(["feature_store"], f"""
SELECT request_id, error, CAST(0 AS BIGINT) AS repeats, CASE WHEN error IS NULL THEN {Q.decision('pd')} END AS decision FROM graded
UNION ALL SELECT event_id::VARCHAR, CASE WHEN late THEN 'late' ELSE 'repeated' END, CASE WHEN late THEN copies ELSE copies - 1 END, NULL
FROM judged WHERE late OR copies > 1""", {**ARRIVED, **M14_PARTS}))
def logged_requests(spark, d):
    """Every request of four arrivals, taken one by one: decided, failed, late or repeated. An arrival is as many files as its rows need."""
    store = V.feature_store(spark, d)
    model = T.load_ensemble(T.node_covers(V.gold(spark, d), V.tree_nodes(spark)), V.BASELINE)
    events = V.table(spark, d, "events").select(F.col("event_id").cast("string").alias("request_id"), "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    bounds = events.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high"), F.count(F.lit(1)).alias("n")).first()
    parts = arrival_parts(bounds["n"])
    third = F.least(F.lit(2), F.floor(3 * (F.unix_micros("ts") - bounds["low"]) / (bounds["high"] - bounds["low"] + 1))).cast("int")
    timed = events.withColumn("file", third + (F.col("event_id") % 7 == 0).cast("int"))
    arrived = timed.unionByName(timed.where("event_id % 5 = 0 and event_id % 7 <> 0"))
    folder = scratch_path(spark, "requests")
    for file in range(4):
        arrived.where(F.col("file") == file).select("request_id", "user_id", "ts").repartition(parts).write.mode("append").parquet(folder)

    def score(batch):
        asked = batch.select("request_id", F.concat(F.lit("LC_"), F.col("user_id").cast("string")).alias("applicant_id"))
        return score_requests(asked, store, model, V.CALIBRATOR, V.now(), V.MODEL_VERSION, 1)

    table = ST.request_log(spark, scratch_path(spark, "request-log"))
    ST.start_request_log(ST.event_stream(spark, folder, per_trigger=parts), score, table, scratch_path(spark, "offsets-requests")).awaitTermination()
    return table.read().select("request_id", "error", "repeats", "decision")


@query("st5_rolling_drift", Q.build(["scored_gold"], f"""
SELECT {text('w')} AS window_start, CAST(sum(a) AS BIGINT) AS n, {r('sum((sa - es) * ln(sa / es))')} AS psi FROM (
  SELECT *, (e + 1) / (sum(e) OVER (PARTITION BY w) + 10)::DOUBLE AS es, (a + 1) / (sum(a) OVER (PARTITION BY w) + 10)::DOUBLE AS sa FROM (
    SELECT w, b, (SELECT count(*) FROM scored_gold WHERE split = 'train' AND score >= lo AND (CASE WHEN b = 9 THEN score <= hi ELSE score < hi END)) AS e,
      (SELECT count(*) FROM decided WHERE time_bucket(INTERVAL 1 DAY, ts) = w AND score >= lo2 AND (CASE WHEN b = 9 THEN score <= hi2 ELSE score < hi2 END)) AS a
    FROM (SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) AS w FROM events),
      (SELECT b, b * 0.1::DOUBLE AS lo, CASE WHEN b = 9 THEN 1::DOUBLE ELSE (b + 1) * 0.1::DOUBLE END AS hi,
              b / 10::DOUBLE AS lo2, (b + 1) / 10::DOUBLE AS hi2 FROM range(10) t(b))))
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY w""", DECIDED))
def rolling_drift(spark, d):
    training = training_distribution(V.scored_gold(spark, d).where("split = 'train'"), "score", V.MODEL_VERSION)
    path, checkpoint = scratch_path(spark, "stream-drift"), scratch_path(spark, "offsets-drift")
    ST.start_drift(decided(spark, d), "score", training, path, checkpoint).awaitTermination()
    return rounded(spark.read.parquet(path).select(stamp("window_start"), "n", "psi"))
