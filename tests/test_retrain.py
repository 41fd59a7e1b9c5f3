"""The retrain job: with and without a champion, resumed, and refused."""

import pytest
from pyspark.sql import functions as F

from checks import q_model as QM, views as V
from riskframe.operators import training as M, trees as T
from riskframe.operators.fairness import fairness_report
from riskframe.operators.ranking import ranking_metrics
from riskframe.plans import retrain as R
from riskframe.session import scratch_path

SMALL = M.BoostingParameters(trees=25, depth=3, learning_rate=0.2, min_rows=10, bins=40, leaves=7)


@pytest.fixture(scope="module")
def splits(spark, data):
    rows = QM.labelled(spark, data).cache()
    return [rows.where(F.col("split") == s) for s in ("train", "val", "test")]


def test_challenger_against_a_champion(spark, data, splits, monkeypatch):
    train, val, test = splits
    champion = T.load_ensemble(T.node_covers(V.gold(spark, data), V.tree_nodes(spark)), V.BASELINE)
    before = fairness_report(T.with_probability(test, champion, "score"), "default", "score")
    path = scratch_path(spark, "retrain")
    job = lambda: R.retrain(train, val, test, QM.MODEL_FEATURES, "default", "id", path, champion, before, SMALL)
    done = job()
    row = done["comparison"].first()
    assert done["comparison"].count() == 1 and row.gate in ("passed", "blocked") and (row.gate == "blocked") == bool(row.gate_reasons)
    assert row.advice == "DO NOT PROMOTE" if row.gate == "blocked" else row.advice in ("PROMOTE", "CONSIDER", "DO NOT PROMOTE")
    own = ranking_metrics(done["scores"], "default", "challenger").first()
    assert row.challenger_auc == pytest.approx(own.auc, abs=1e-4) and row.auc_delta == pytest.approx(row.challenger_auc - row.champion_auc, abs=1e-4)
    assert done["scores"].count() == test.count() and done["scores"].where("pd is null or pd < 0 or pd > 1").count() == 0
    brier = {r.series: r.brier for r in done["brier"].collect()}
    assert set(brier) == {"challenger", "pd"} and {r.series for r in done["reliability"].collect()} == {"challenger", "pd"}
    assert T.invalid_nodes(done["nodes"], QM.MODEL_FEATURES).count() == 0
    # a second run finds every table and fits nothing
    monkeypatch.setattr(R, "train_boosted", None)
    assert job()["comparison"].collect() == done["comparison"].collect()


def test_the_first_model_and_a_broken_export(spark, splits, monkeypatch):
    train, val, test = splits
    path = scratch_path(spark, "retrain")
    real = R.export_nodes
    monkeypatch.setattr(R, "export_nodes", lambda spark, model: real(spark, model).withColumn("value", F.col("value") + 1))
    with pytest.raises(Exception, match="do not reproduce"):
        R.retrain(train, val, test, QM.MODEL_FEATURES, "default", "id", path, parameters=SMALL)
    monkeypatch.setattr(R, "export_nodes", real)
    row = R.retrain(train, val, test, QM.MODEL_FEATURES, "default", "id", path, parameters=SMALL)["comparison"].first()
    assert (row.gate, row.advice, row.champion_auc, row.score_psi) == ("skipped", "PROMOTE", None, None) and row.auc_delta == row.challenger_auc
