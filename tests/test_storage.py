"""Layers, logs, joins, retention and the decision stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.operators import history as H, joins as J
from riskframe.session import scratch_path
from riskframe.sources import feature_store as S, layers, logs as L
from riskframe.streaming import decisions as ST

NOW = datetime(2024, 2, 15)


def test_write_once_replaces_only_incomplete_layers(spark):
    path = scratch_path(spark, "once")
    assert layers.write_once(spark.range(3), path)
    assert not layers.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    layers.remove_directory(spark, f"{path}/_SUCCESS")
    assert layers.write_once(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_checked_layer_is_complete_only_when_it_passes(spark):
    from riskframe.operators.quality import QualityError, bronze_checks

    rows = spark.range(4).withColumn("ingested_at", F.lit("now"))
    path = scratch_path(spark, "checked")
    with pytest.raises(QualityError):
        layers.write_checked(rows, path, bronze_checks, "bronze", strict=True)
    assert not layers.is_complete(spark, path)
    good = rows.withColumn("source_file", F.lit("x"))
    assert layers.write_checked(good, path, bronze_checks, "bronze", strict=True) and layers.is_complete(spark, path)
    assert not layers.write_checked(good.limit(0), path, bronze_checks, "bronze")
    loose = scratch_path(spark, "checked")
    assert layers.write_checked(rows, loose, bronze_checks, "bronze") and spark.read.parquet(loose).count() == 4


def test_raw_csv(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "loans.csv.gz", "wt") as f:
        f.write('id,desc,term\n1,"two\nlines, and ""quotes""", 36 months\n,,\n2,,60\n')
    rows = layers.read_raw_csv(spark, str(tmp_path / "loans.csv.gz"), ["id", "desc", "term"], NOW, partitions=2)
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"1", "2"} and got["1"]["desc"] == 'two\nlines, and "quotes"' and got["1"]["term"] == " 36 months"
    assert got["2"]["desc"] is None and got["1"]["source_file"] == "loans.csv.gz" and got["1"]["ingested_at"].startswith("2024-02-15")
    assert rows.rdd.getNumPartitions() == 2


def test_plain_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text('id,desc,term\n1,"two\nlines, and ""quotes""", 36 months\n,,\n2,,60\n')
    rows = layers.read_raw_csv(spark, str(path), ["id", "desc", "term"], NOW).collect()
    assert {(r["id"], r["desc"], r["term"]) for r in rows} == {("1", 'two\nlines, and "quotes"', " 36 months"), ("2", None, "60")}
    with pytest.raises(ValueError, match="line breaks"):
        layers.read_raw_csv(spark, str(path), ["id", "desc", "term"], NOW, multi_line=False)
    path.write_text('id,desc,term\n1,"a ""b""",36\n')
    assert [r["desc"] for r in layers.read_raw_csv(spark, str(path), ["id", "desc", "term"], NOW, multi_line=False).collect()] == ['a "b"']


def test_numeric_reader(spark):
    path = scratch_path(spark, "numeric")
    spark.createDataFrame([(1, True, None), (2, False, 2.5)], "a int, b boolean, c float").write.parquet(path)
    rows = layers.read_numeric(spark, path, ["b", "a", "b", "c"])
    assert rows.dtypes == [("b", "double"), ("a", "double"), ("c", "double")]
    assert sorted(tuple(r) for r in rows.select("a", "b").collect()) == [(1.0, 1.0), (2.0, 0.0)]
    with pytest.raises(ValueError, match="nope"):
        layers.read_numeric(spark, path, ["a", "nope"])


def test_full_medallion_run(spark, data, tmp_path):
    from checks import views as V
    from checks.q_prepare import RAW_COLUMNS
    from riskframe.plans import medallion as M

    csv = str(tmp_path / "csv")
    V.loans_view(spark, data).select(*RAW_COLUMNS).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(csv)
    root = str(tmp_path / "lake")
    bronze = M.bronze(spark, csv, RAW_COLUMNS, root, "accepted", NOW, strict=True, partitions=2)
    silver = M.silver(spark, bronze, root)
    gold = M.gold(spark, silver, root)
    assert gold.count() == V.fresh_silver(spark, data).count() and set(gold.select("split").distinct().toPandas()["split"]) <= {"train", "val", "test"}
    assert spark.read.text(f"{root}/gold/metadata").count() == 1
    rejected = M.rejected(spark, V.rejected_view(spark, data), root)
    assert rejected.where("default is not null").count() == 0


def store_rows(spark, rows):
    return spark.createDataFrame(
        [(a, v, t, {"x": x}, 1.0, 700, 1) for a, v, t, x in rows],
        "applicant_id string, feature_version int, computed_at timestamp, features map<string,double>, data_completeness double, fico_score int, grade int")


def test_upsert_replaces_on_the_key(spark):
    old = store_rows(spark, [("a", 1, NOW, 1.0), ("b", 1, NOW, 2.0), ("a", 2, NOW, 3.0)])
    # the incoming row wins even if it was computed earlier
    new = store_rows(spark, [("a", 1, NOW - timedelta(days=9), 10.0), ("a", 1, NOW - timedelta(days=8), 11.0), ("c", 1, NOW, 12.0)])
    got = {(r["applicant_id"], r["feature_version"]): r["features"]["x"] for r in S.upsert(old, new).collect()}
    assert got == {("a", 1): 11.0, ("b", 1): 2.0, ("a", 2): 3.0, ("c", 1): 12.0}
    table = S.feature_table(spark, scratch_path(spark, "store"))
    S.write_upsert(table, old)
    before = table.manifest()
    after = S.write_upsert(table, new)
    read = lambda rows: {(r["applicant_id"], r["feature_version"]): r["features"]["x"] for r in rows.collect()}
    assert read(table.read()) == got and read(table.read(number=before.number)) == read(old)
    # the version that the batch does not touch is referenced where it stands
    assert after.parts["2"] == before.parts["2"] and after.parts["1"] != before.parts["1"]
    assert read(table.read(["2"])) == {("a", 2): 3.0} and table.read(["9"]).count() == 0
    assert S.write_upsert(table, new.where("false")) == after
    tied = store_rows(spark, [("a", 1, NOW, 5.0), ("a", 1, NOW, 6.0)])
    assert S.upsert(old, tied).collect() == S.upsert(old, tied.orderBy(F.desc("features.x"))).collect()


def test_snapshot_contract_and_missing_id(spark):
    S.check_contract(0, 1, ["a"], ["a"])
    for bad in ((2, 1, ["a"], ["a"]), (1, 1, ["a", "b"], ["b", "a"])):
        with pytest.raises(ValueError):
            S.check_contract(*bad)
    rows = spark.createDataFrame([(7, 1.0, None, 700.0, 2.0)], "id bigint, a double, b double, fico_score double, grade_numeric double")
    r = S.snapshots(rows, ["a", "b", "fico_score"], 1, F.lit(NOW).cast("timestamp")).first()
    assert r["applicant_id"] == "LC_7" and r["features"] == {"a": 1.0, "b": None, "fico_score": 700.0} and r["data_completeness"] == 0.667
    with pytest.raises(Exception, match="no loan id"):
        S.snapshots(rows.withColumn("id", F.lit(None).cast("bigint")), ["a"], 1, F.lit(NOW).cast("timestamp")).collect()


def log(spark, rows):
    return spark.createDataFrame(rows, "request_id string, applicant_id string, scored_at timestamp, actual_default boolean, outcome_observed_at timestamp")


def test_backfill(spark):
    day = NOW - timedelta(days=40)
    rows = log(spark, [
        ("1", "LC_1", day, None, None), ("2", "LC_1", NOW, None, None), ("3", "LC_1", day, True, day), ("4", "LC_2", day, None, None),
        ("5", "bad", day, None, None), ("6", "LC_3", NOW, None, None)])
    outcomes = spark.createDataFrame([(1, False), (3, True)], "id bigint, label boolean")
    now = F.lit(NOW).cast("timestamp")
    got = {r["request_id"]: r for r in J.backfill_outcomes(rows, outcomes, now, 30).collect()}
    # every open row of a due applicant changes, also the recent one; a known outcome stays
    assert got["1"]["actual_default"] is False and got["2"]["actual_default"] is False and got["2"]["outcome_observed_at"] == NOW
    assert got["3"]["actual_default"] is True and got["3"]["outcome_observed_at"] == day
    assert all(got[k]["actual_default"] is None for k in "456")
    report = J.backfill_report(rows, outcomes, now, 30).first().asDict()
    assert report == {"pending_applicants": 3, "matched_applicants": 1, "skipped_unmatched": 2, "rows_updated": 2}


def test_lookup_versions(spark):
    store = store_rows(spark, [("a", 1, NOW, 1.0), ("a", 2, NOW, 2.0), ("b", 2, NOW, 3.0)])
    ask = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "applicant_id string")
    exact = [(r["applicant_id"], r["status"], r["features"] and r["features"]["x"]) for r in J.lookup_features(ask, store, 1).collect()]
    assert sorted(exact, key=str) == [("a", "found", 1.0), ("a", "found", 1.0), ("b", "version_missing", None), ("c", "not_found", None)]
    latest = {r["applicant_id"]: r["feature_version"] for r in J.lookup_features(ask, store, 0).collect()}
    assert latest == {"a": 2, "b": 2, "c": None}


def test_unpublished_and_history(spark):
    drift = spark.createDataFrame(
        [("psi", NOW - timedelta(days=i), float(i), "v1", '{"csi": {"dti": 0.1, "fico": 0.3}}') for i in range(5)] + [("auc", NOW, 0.7, "v1", "{}")],
        "metric_name string, measured_at timestamp, metric_value double, model_version string, details string")
    assert [r["metric_value"] for r in H.metric_history(drift, "psi", 3).collect()] == [2.0, 1.0, 0.0]
    assert {r["metric_name"]: r["metric_value"] for r in H.latest_metrics(drift).collect()} == {"psi": 0.0, "auc": 0.7}
    details = H.metric_details(drift.where("metric_value = 0")).collect()
    assert [(r["feature"], r["value"]) for r in details] == [("fico", 0.3), ("dti", 0.1)]
    new = spark.createDataFrame([("psi", "v1"), ("fairness", "v1"), ("psi", "v2")], "metric_name string, model_version string")
    assert sorted(tuple(r) for r in J.unpublished(new, drift).collect()) == [("fairness", "v1"), ("psi", "v2")]


def decisions(spark, times):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(times)], "request_id string, scored_at timestamp").withColumns(
        {"applicant_id": F.lit("LC_1"), "score": F.lit(0.123456), "calibrated_pd": F.lit(None).cast("double"), "decision": F.lit("approve")})


def test_prune_drops_days_and_cuts_the_boundary(spark):
    path = scratch_path(spark, "prune")
    edge = NOW - timedelta(days=10)
    times = [edge - timedelta(days=3), edge - timedelta(days=1), edge - timedelta(hours=1), edge + timedelta(hours=1), NOW]
    noon = NOW + timedelta(hours=12)
    L.append_decisions(decisions(spark, times + [edge + timedelta(hours=13)]), path)
    assert L.prune_decisions(spark, path, noon, 10) == 4
    left = sorted(r["request_id"] for r in spark.read.parquet(path).collect())
    assert left == ["4", "5"]
    assert L.prune_decisions(spark, path, noon, 10) == 0
    assert L.list_partitions(spark, path, "scored_date") == ["2024-02-05", "2024-02-15"]
    with pytest.raises(ValueError):
        L.prune_decisions(spark, path, noon, 0)
    assert spark.read.parquet(path).schema["score"].dataType.simpleString() == "decimal(6,5)"


def test_retained(spark):
    rows = decisions(spark, [NOW - timedelta(days=d) for d in (0, 749, 750, 751)])
    now = F.lit(NOW).cast("timestamp")
    assert J.retained(rows, now, 750).count() == 3
    assert J.retention_report(rows, now, 750).first()["rows_deleted"] == 1


# ---------------------------------------------------------------- streams

def write_events(spark, path, rows):
    spark.createDataFrame(rows, "request_id string, ts timestamp, score double, decision string").coalesce(1).write.mode("append").parquet(path)


def minute(m, s=0):
    return datetime(2024, 1, 1, 0, m, s) if m < 60 else datetime(2024, 1, 1, m // 60, m % 60, s)


def test_windowed_counts_match_batch_and_drop_late_rows(spark):
    path, out, state = (scratch_path(spark, "ev") for _ in range(3))
    write_events(spark, path, [(str(i), minute(i), 0.1, "approve") for i in range(40)])
    stream = ST.windowed_counts(ST.event_stream(spark, path), ["decision"])
    ST.start_append(stream, out, state).awaitTermination()
    first = {r["window_start"]: r["count"] for r in spark.read.parquet(out).collect()}
    batch = {r["window_start"]: r["count"] for r in ST.windowed_counts(spark.read.parquet(path), ["decision"]).collect()}
    # latest event at minute 39: windows up to minute 29 are final
    assert first == {k: v for k, v in batch.items() if k <= minute(20)}
    # a late row for a closed window is dropped, new rows close further windows
    write_events(spark, path, [("late", minute(1), 0.1, "approve"), ("x", minute(80), 0.1, "approve")])
    ST.start_append(ST.windowed_counts(ST.event_stream(spark, path), ["decision"]), out, state).awaitTermination()
    second = {r["window_start"]: r["count"] for r in spark.read.parquet(out).collect()}
    assert second[minute(0)] == 5 and max(second) == minute(35)


def test_bucket_quantile(spark):
    rows = spark.createDataFrame([([0, 4, 4, 2],), ([0, 0, 0, 0],), ([3, 0, 0, 0],)], "counts array<bigint>")
    q = [r[0] for r in rows.select(ST.bucket_quantile("counts", [0.0, 0.1, 0.2], 0.5)).collect()]
    assert q[0] == pytest.approx(0.125) and q[1] is None and q[2] == 0.0
    top = rows.select(ST.bucket_quantile("counts", [0.0, 0.1, 0.2], 0.9)).first()[0]
    assert top == 0.2


def test_scored_stream_is_replay_safe(spark):
    path, out, state = (scratch_path(spark, "sc") for _ in range(3))
    write_events(spark, path, [("1", minute(0), 0.2, "a"), ("1", minute(0), 0.2, "a"), ("2", minute(1), 0.4, "a")])
    requests = ST.event_stream(spark, path)
    run = lambda: ST.start_scoring(requests, lambda b: b.select("request_id", (F.col("score") * 2).alias("s")), out, state).awaitTermination()
    run()
    assert sorted(r["request_id"] for r in spark.read.parquet(out).collect()) == ["1", "2"]
    run()
    assert spark.read.parquet(out).count() == 2
    # forget the last commit: the batch runs again and overwrites its own part
    fs = [p for p in layers_commits(spark, state)]
    layers.remove_directory(spark, fs[-1])
    run()
    assert sorted(r["request_id"] for r in spark.read.parquet(out).select("request_id").collect()) == ["1", "2"]


def test_request_log_keeps_late_and_repeated_requests(spark):
    path, state = scratch_path(spark, "rl"), scratch_path(spark, "rl")
    table = ST.request_log(spark, scratch_path(spark, "rl"))
    requests = None

    def run(lateness=10):
        def score(b):
            return b.select("request_id", F.when(F.col("score") < 0, F.lit("negative")).alias("error"), (F.col("score") * 2).alias("s"))

        ST.start_request_log(requests, score, table, state, lateness_minutes=lateness).awaitTermination()

    def rows():
        return sorted((str(r.request_id), str(r.error), r.repeats, r.s) for r in table.read().collect())

    write_events(spark, path, [("1", minute(0), 0.2, "a"), ("1", minute(0), 0.2, "a"), ("1", minute(1), 0.3, "a"), ("2", minute(30), 0.4, "a"), ("3", minute(5), -1.0, "a"), ("4", None, 0.5, "a")])
    requests = ST.event_stream(spark, path)
    run()
    first = [("1", "None", 0, 0.4), ("1", "repeated", 1, None), ("1", "repeated", 1, None), ("2", "None", 0, 0.8), ("3", "negative", 0, -2.0), ("4", "no_time", 1, None)]
    assert rows() == sorted(first)
    assert {p.split(" ")[0] for p in table.manifest().parts} == {"results", "errors"} and len(table.manifest().parts) == 3
    # late by the first file's latest time; repeated within ten minutes; the same id long after is a new request
    write_events(spark, path, [("5", minute(19), 0.1, "a"), ("6", minute(21), 0.1, "a"), ("2", minute(31), 0.4, "a"), ("1", minute(40), 0.3, "a"), ("5", minute(19), 0.1, "a")])
    run()
    second = [("5", "late", 2, None), ("6", "None", 0, 0.2), ("2", "repeated", 1, None), ("1", "None", 0, 0.6)]
    assert rows() == sorted(first + second)
    before = table.manifest()
    run()  # nothing new
    layers.remove_directory(spark, layers_commits(spark, state)[-1])
    run()  # the last batch runs again and finds its number
    assert rows() == sorted(first + second) and table.manifest().number == before.number


def layers_commits(spark, state):
    fs, target = layers._filesystem(spark, f"{state}/commits")
    return sorted((str(s.getPath()) for s in fs.listStatus(target) if s.getPath().getName().isdigit()), key=lambda p: int(p.rsplit("/", 1)[1]))


def test_window_drift_matches_psi(spark):
    import math

    histograms = spark.createDataFrame([(minute(0), minute(5), [5, 0, 5])], "window_start timestamp, window_end timestamp, counts array<bigint>")
    training = spark.createDataFrame([([10, 10, 0],)], "bin_counts array<bigint>")
    got = ST.window_drift(histograms, training).first()
    e, a = [11 / 23, 11 / 23, 1 / 23], [6 / 13, 1 / 13, 6 / 13]
    assert got["n"] == 10 and got["psi"] == pytest.approx(sum((y - x) * math.log(y / x) for x, y in zip(e, a)))


def test_lookup_of_many_applicants_is_cut_by_its_rows(spark, monkeypatch):
    assert J.lookup_parts(12, 990_000, 562_000) == 12 and J.lookup_parts(12, 59_000_000, 36_000_000) == 360 and J.lookup_parts(12, 59_000_000, 0) == 118
    store = store_rows(spark, [(f"a{i}", v, NOW, float(10 * i + v)) for i in range(60) for v in (1, 2) if i % 3 or v == 2])
    ask = spark.createDataFrame([(str(i), f"a{i % 80}") for i in range(200)] + [("x", None)], "request_id string, applicant_id string")

    def want(version):
        held = {(r["applicant_id"], r["feature_version"]): r["features"]["x"] for r in store.collect()}
        for r in ask.collect():
            of = sorted(v for a, v in held if a == r["applicant_id"])
            v = version or (of[-1] if of else None)
            yield r["request_id"], "not_found" if not of else "found" if v in of else "version_missing", held.get((r["applicant_id"], v))

    few = {v: J.lookup_features(ask, store, v) for v in (0, 1)}
    monkeypatch.setattr(J, "FEW_APPLICANTS", 5)
    monkeypatch.setattr(J, "STORE_ROWS_PER_TASK", 10)
    many = {v: J.lookup_features(ask, store, v) for v in (0, 1)}
    for found in (few, many):
        for v, rows in found.items():
            assert sorted((r["request_id"], r["status"], r["features"] and r["features"]["x"]) for r in rows.collect()) == sorted(want(v))
    plan = many[1].select("request_id", "status", "grade")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 10), ") == plan.count("hashpartitioning(applicant_id#") == 3
    assert many[1].columns == ["request_id", "applicant_id", "status", *J.SNAPSHOT]


def test_lookup_moves_only_the_columns_that_are_read(spark):
    store = store_rows(spark, [("a", 1, NOW, 1.0)]).repartition(2)
    ask = spark.createDataFrame([("a",)], "applicant_id string")
    plan = J.lookup_features(ask, store, 1).select("status", "grade")._jdf.queryExecution().optimizedPlan().toString()
    assert "features" not in plan.split("LogicalRDD")[0]


def test_scored_stream_scores_no_empty_batch_and_reads_a_batch_once(spark):
    path, out, state = (scratch_path(spark, "se") for _ in range(3))
    write_events(spark, path, [("1", minute(0), 0.2, "a"), ("1", minute(0), 0.2, "a"), ("2", minute(30), 0.4, "a")])
    calls = []

    def score(batch):
        calls.append((batch.is_cached, batch.count()))
        return batch.select("request_id")

    ST.start_scoring(ST.event_stream(spark, path), score, out, state).awaitTermination()
    assert calls == [(True, 2)] and spark.read.parquet(out).count() == 2


def test_only_repeated_keys_of_a_batch_are_grouped(spark):
    rows = [("a", 1, NOW, 1.0), ("a", 1, NOW - timedelta(days=1), 2.0), ("b", 1, NOW, 3.0), ("b", 2, NOW, 4.0), ("c", 1, NOW, 5.0), ("c", 1, NOW, 6.0),
            (None, 1, NOW, 7.0), (None, 1, NOW - timedelta(days=2), 8.0)]
    batch = store_rows(spark, rows)
    payload = F.struct(*[c for c in batch.columns if c not in S.KEY])
    grouped = batch.groupBy(*S.KEY).agg(F.max_by(payload, F.struct("computed_at", F.xxhash64(F.to_json(payload)))).alias("r")).select(*S.KEY, "r.*")
    read = lambda df: sorted(((r["applicant_id"] or "", r["feature_version"], r["features"]["x"]) for r in df.collect()))
    got = S.latest_rows(batch)
    assert read(got) == read(grouped) and got.columns == batch.columns
    once = S.latest_rows(batch.where("applicant_id = 'b'"))
    assert len(once.collect()) == 2 and "Join LeftAnti" in once._jdf.queryExecution().analyzed().toString()
