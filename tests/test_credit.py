"""Silver, gold, gates, fairness and verdicts on small frames."""

import pytest
from pyspark.sql import functions as F

from riskframe.contract import Contract
from riskframe.functions.tables import DEFAULT_STATUSES, FEATURES, ORIGINATION_COLUMNS, PAID_STATUSES
from riskframe.operators import fairness as X, gold as G, quality as D, silver as P, verdicts as W

LEAKS = {"total_pymnt", "recoveries", "last_pymnt_d", "out_prncp", "loan_status", "last_fico_range_high"}


def summary(spark, **groups):
    return spark.createDataFrame(
        [("home_ownership", g, float(x), x < 0.8) for g, x in groups.items()], "attribute string, group string, dir double, violation boolean")


def test_status_sets_and_columns():
    assert not set(DEFAULT_STATUSES) & set(PAID_STATUSES)
    assert len(ORIGINATION_COLUMNS) == 25 and not LEAKS & set(ORIGINATION_COLUMNS)
    assert len(FEATURES) == 33 and not {"grade", "sub_grade", "id", "default"} & set(FEATURES)


def test_resolved_loans(spark):
    rows = spark.createDataFrame([(s,) for s in ("Charged Off", "Fully Paid", "Current", "Default", "In Grace Period", None)], "loan_status string")
    assert sorted((r[0], r[1]) for r in P.resolved_loans(rows).collect()) == [("Charged Off", 1), ("Default", 1), ("Fully Paid", 0)]


def test_median_fill_uses_the_fitted_frame(spark):
    rows = spark.createDataFrame([(1.0, None), (2.0, 5.0), (None, 7.0), (10.0, None)], "a double, b double")
    filled = P.fill_medians(rows, ["a", "b"])
    assert sorted(r["a"] for r in filled.collect()) == [1.0, 2.0, 2.0, 10.0]
    assert sorted(r["b"] for r in filled.collect()) == [5.0, 6.0, 6.0, 7.0]
    other = P.fill_medians(rows, ["a", "b"], fit_on=rows.where("a > 5 or b = 7"))
    assert sorted(r["a"] for r in other.collect()) == [1.0, 2.0, 10.0, 10.0]
    empty = P.fill_medians(rows.withColumn("c", F.lit(None).cast("double")), ["c"])
    assert empty.where("c is null").count() == 4


def test_category_codes_are_sorted_and_unseen_is_minus_one(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "k string")
    codes = G.fit_categories(rows, ["k"])
    assert {r["category"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    other = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert [r["k"] for r in G.encode_categories(other, codes, ["k"]).collect()] == [0, -1, -1]


def test_zero_income_and_missing_flags(spark):
    rows = spark.createDataFrame([(0.0, 100.0, 10.0, 5.0, None, None, 1.0, 0.0)],
        "annual_inc double, loan_amnt double, installment double, dti double, delinq_2yrs double, revol_util double, mort_acc double, pub_rec_bankruptcies double")
    r = G.threshold_flags(G.income_ratios(rows)).first()
    assert (r["loan_to_income"], r["installment_to_income"], r["dti_x_income"], r["log_annual_inc"]) == (0, 0, 0, 0)
    assert (r["delinq_ever"], r["high_utilization"], r["has_mortgage"], r["has_bankruptcy"]) == (0, 0, 1, 0)


def test_split_borders(spark):
    rows = spark.createDataFrame([("2015-12-31",), ("2016-01-01",), ("2017-06-30",), ("2017-07-01",), (None,)], "d string").select(F.to_date("d").alias("issue_d"))
    assert [r["split"] for r in G.time_split(rows).collect()] == ["train", "val", "val", "test"]


GOOD = dict(loan_amnt=1000.0, int_rate=10.0, fico_score=700, annual_inc=5e4, dti=20.0, default=0)


def silver_frame(spark, n=20, **bad):
    rows = [dict(GOOD, default=int(i % 4 == 0)) for i in range(n)]
    rows[0].update(bad)
    return spark.createDataFrame(rows, "loan_amnt double, int_rate double, fico_score int, annual_inc double, dti double, default int")


def failed(checks):
    return sorted(r["expectation"] for r in checks.where("not success").collect())


@pytest.mark.parametrize("bad,name", [
    ({}, []), ({"loan_amnt": None}, ["loan_amnt_not_null"]), ({"fico_score": 900}, ["fico_score_between_300_850"]), ({"annual_inc": -1.0}, ["annual_inc_non_negative"]),
    ({"dti": 101.0}, ["dti_between_0_100"]), ({"dti": None}, ["dti_between_0_100"]), ({"default": 2}, ["default_is_binary"])])
def test_silver_gate(spark, bad, name):
    assert failed(D.silver_checks(silver_frame(spark, **bad))) == name


def test_empty_frame_fails_count_and_rate_only(spark):
    assert failed(D.silver_checks(silver_frame(spark).limit(0))) == [
        "default_rate_between_5_50_pct", "fico_score_not_null", "int_rate_not_null", "loan_amnt_not_null", "row_count_gt_zero"]


def test_gold_gate_ignores_nulls(spark):
    rows = spark.range(2000).select((F.col("id") % 7 + 1).alias("grade_numeric"), (F.col("id") % 4 == 0).cast("int").alias("default"),
                                    F.when(F.col("id") > 5, F.col("id") % 2).alias("delinq_ever"), F.lit(None).cast("int").alias("sub_grade_numeric"))
    assert failed(D.gold_checks(rows, expected=None)) == []
    assert failed(D.gold_checks(rows.withColumn("delinq_ever", F.lit(3)), expected=["grade_numeric", "dti"])) == ["all_feature_columns_present", "delinq_ever_is_binary"]
    assert failed(D.gold_checks(rows.limit(1000), expected=None)) == ["row_count_gt_1000"]


def test_bronze_gate_and_strict_mode(spark):
    rows = spark.range(3).withColumn("ingested_at", F.lit("now"))
    assert failed(D.bronze_checks(rows)) == ["source_file_exists"]
    assert D.run_gate(rows, D.bronze_checks, "bronze").count() == 3
    with pytest.raises(D.QualityError, match="source_file_exists"):
        D.run_gate(rows, D.bronze_checks, "bronze", strict=True)


def groups(spark, rates, privileged="A", good=None):
    return spark.createDataFrame(
        [("x", g, g == privileged, r, 0.2, (good or rates)[g]) for g, r in rates.items()],
        "attribute string, group string, privileged boolean, approval_rate double, default_rate double, approve_rate_good double")


def test_disparity_values(spark):
    bad = {r["group"]: r for r in X.disparate_impact(groups(spark, {"A": 0.60, "B": 0.40})).collect()}
    assert bad["B"]["dir"] == 0.6667 and bad["B"]["violation"] and bad["A"]["dir"] == 1.0 and not bad["A"]["violation"]
    ok = {r["group"]: r for r in X.disparate_impact(groups(spark, {"A": 0.50, "B": 0.45})).collect()}
    assert ok["B"]["dir"] == 0.9 and not ok["B"]["violation"]
    assert X.disparate_impact(groups(spark, {"A": 0.0, "B": 0.4})).count() == 0
    assert X.disparate_impact(groups(spark, {"B": 0.4, "C": 0.5})).count() == 0
    eod = {r["group"]: r["eod"] for r in X.equal_opportunity(groups(spark, {"A": 0.5, "B": 0.5}, good={"A": 0.70, "B": 0.85})).collect()}
    assert eod["B"] == 0.15
    spd = {r["group"]: r["spd"] for r in X.statistical_parity(groups(spark, {"A": 0.60, "B": 0.40})).collect()}
    assert spd["B"] == -0.2


def test_small_groups_are_left_out(spark):
    rows = spark.range(60).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 100).alias("s"), F.when(F.col("id") < 9, 1).otherwise(0).alias("home_ownership"))
    found = X.group_metrics(rows, "y", "s").collect()
    assert [r["group"] for r in found] == ["MORTGAGE"] and found[0]["count"] == 51


def test_worst_impact(spark):
    assert X.worst_impact(summary(spark, A=1.0, B=0.634, C=0.499)).first()[0] == 0.499
    assert X.worst_impact(summary(spark, A=1.3)).first()[0] == 1.0
    with pytest.raises(Exception, match="no groups"):
        X.worst_impact(summary(spark, A=1.0).limit(0)).collect()


@pytest.mark.parametrize("champion,challenger,want", [
    (0.90, 0.70, "blocked"), (0.70, 0.71, "passed"), (0.70, 0.60, "blocked"), (0.70, 0.695, "passed"), (None, 0.70, "blocked"), (0.70, None, "blocked")])
def test_fairness_gate(spark, champion, challenger, want):
    row = X.fairness_gate(spark, None if champion is None else summary(spark, RENT=champion), None if challenger is None else summary(spark, RENT=challenger)).first()
    assert row["gate"] == want and (len(row["reasons"]) > 0) == (want == "blocked")


def test_gate_skipped_without_champion(spark):
    assert X.fairness_gate(spark, None, summary(spark, RENT=0.5), has_champion=False).first()["gate"] == "skipped"


@pytest.mark.parametrize("champion,challenger,calibrated,want", [
    (None, 0.9, True, "APPROVED"), (None, 0.7, True, "REVIEW REQUIRED"), (None, 0.9, False, "REVIEW REQUIRED"), (0.70, 0.70, True, "APPROVED"),
    (0.70, 0.60, True, "REVIEW REQUIRED"), (0.85, 0.70, True, "REVIEW REQUIRED"), (None, None, True, "REVIEW REQUIRED"), (0.70, 0.70, False, "REVIEW REQUIRED")])
def test_validation_verdict(spark, champion, challenger, calibrated, want):
    make = lambda x: None if x is None else summary(spark, RENT=x)
    row = X.validation_verdict(spark, make(challenger), make(champion), calibrated).first()
    assert row["status"] == want
    if (champion, challenger, calibrated) == (0.70, 0.70, True):
        assert "inherited DIR violations on home_ownership/RENT not worsened" in row["rationale"]


def drift(spark, psi, n, real, drifted=None):
    names = None if drifted is None else spark.createDataFrame([(f, 0.3) for f in drifted], "feature string, csi double")
    return W.drift_verdict(spark.createDataFrame([(psi,)], "psi double"), F.lit(n), names, real).first()


def test_drift_verdicts(spark):
    proxy = drift(spark, 0.9, 5000, False)
    assert proxy["psi_status"] == "CRITICAL" and not proxy["needs_retrain"] and proxy["recommendation"].startswith("DIAGNOSTIC ONLY")
    few = drift(spark, 0.9, 499, True)
    assert few["psi_status"] == "INSUFFICIENT_DATA" and not few["monitoring_eligible"] and "Only 499" in few["recommendation"]
    critical = drift(spark, 0.26, 500, True)
    assert critical["needs_retrain"] and critical["retrain_reasons"] == ["psi_critical (0.2600)"]
    watch = drift(spark, 0.2, 500, True, ["b", "a"])
    assert watch["psi_status"] == "WARNING" and "a, b" in watch["recommendation"] and not watch["needs_retrain"]
    assert drift(spark, 0.05, 500, True)["recommendation"].startswith("No action needed")


def scored(spark, flip):
    return spark.range(200).select((F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * (-1 if flip else 1) + F.col("id") / 1000).alias("s"))


def test_performance_verdicts(spark):
    good = W.performance_verdict(scored(spark, False), "y", "s", {"test": 0.9}).first()
    assert good["auc"] == 1.0 and good["auc_drop"] == -0.1 and good["recommendation"].startswith("Model performance stable")
    bad = W.performance_verdict(scored(spark, True), "y", "s", {"val": 0.9}).first()
    assert bad["needs_retrain"] and bad["retrain_reasons"] == ["auc_drop (0.9000)"]
    none = W.performance_verdict(scored(spark, False), "y", "s", {}).first()
    assert none["recommendation"].startswith("INSUFFICIENT BASELINE") and none["auc"] == 1.0
    one = W.performance_verdict(scored(spark, False).where("y = 1"), "y", "s", {"test": 0.9}).first()
    assert one["recommendation"].startswith("INSUFFICIENT OUTCOMES") and one["auc"] is None


def test_retrain_decision(spark):
    both = W.retrain_decision([W.drift_verdict(spark.createDataFrame([(0.3,)], "psi double"), F.lit(900), None, True), W.performance_verdict(scored(spark, True), "y", "s", {"test": 0.9})]).first()
    assert both["decision"] == "retrain" and both["reason"] == "psi_critical (0.3000), auc_drop (0.9000)"
    neither = W.retrain_decision([W.drift_verdict(spark.createDataFrame([(0.3,)], "psi double"), F.lit(9), None, True)]).first()
    assert (neither["decision"], neither["reason"]) == ("skip_retrain", "")


@pytest.mark.parametrize("champion,challenger,gate,want", [
    (0.70, 0.71, "passed", "PROMOTE"), (0.70, 0.702, "passed", "CONSIDER"), (0.70, 0.69, "passed", "DO NOT PROMOTE"), (0.70, 0.75, "blocked", "DO NOT PROMOTE"), (None, 0.6, "skipped", "PROMOTE")])
def test_promotion(spark, champion, challenger, gate, want):
    row = spark.createDataFrame([(champion, challenger)], "champion_auc double, challenger_auc double")
    assert W.promotion_advice(row, spark.createDataFrame([(gate,)], "gate string")).first()["advice"] == want


@pytest.mark.parametrize("delta,psi,dir_,want", [(0.01, 0.1, 0.9, "PROMOTE"), (0.01, 0.3, 0.9, "CAUTION"), (0.0, 0.1, 0.9, "KEEP CHAMPION"), (0.01, 0.1, 0.7, "DO NOT PROMOTE")])
def test_reject_inference_advice(spark, delta, psi, dir_, want):
    row = spark.createDataFrame([(delta, psi)], "auc_delta double, score_psi double")
    assert W.reject_inference_advice(row, summary(spark, RENT=dir_)).first()["advice"] == want
    assert Contract().psi_critical == 0.25
