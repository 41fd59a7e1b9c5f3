"""Trees, attributions, reasons, training and sampling against brute force."""

import itertools
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import views as V
from riskframe.operators import history as H, training as M, trees as T
from riskframe.operators.trees import Ensemble, Node


def leaf(value, cover):
    return Node(None, None, None, None, None, value, cover)


def stump(missing_left=True, covers=(60.0, 40.0)):
    return Ensemble([{0: Node("f0", 0.5, missing_left, 1, 2, None, sum(covers)), 1: leaf(-1.0, covers[0]), 2: leaf(1.0, covers[1])}])


def random_tree(rng, depth, features):
    nodes = {}

    def grow(d):
        i = len(nodes)
        nodes[i] = None
        if d == 0 or (d < depth and rng.random() < 0.15):
            nodes[i] = leaf(rng.gauss(0, 1), float(rng.randrange(1, 50)))
            return i
        f, t, m = rng.choice(features), rng.random(), rng.random() < 0.5
        left, right = grow(d - 1), grow(d - 1)
        nodes[i] = Node(f, t, m, left, right, None, nodes[left].cover + nodes[right].cover)
        return i

    grow(depth)
    return nodes


def walk(tree, x, known=None):
    """Value of a tree; features outside ``known`` are averaged by cover."""

    def go(i):
        n = tree[i]
        if n.is_leaf:
            return n.value
        if known is not None and n.feature not in known:
            return sum(tree[c].cover * go(c) for c in (n.left, n.right)) / n.cover
        v = x[n.feature]
        left = n.missing_left if v is None else v <= n.threshold
        return go(n.left if left else n.right)

    return go(0)


def shapley(ensemble, x, features):
    phi = dict.fromkeys(features, 0.0)
    for tree in ensemble.trees:
        for f in features:
            rest = [g for g in features if g != f]
            for k in range(len(rest) + 1):
                for s in itertools.combinations(rest, k):
                    w = math.factorial(k) * math.factorial(len(features) - k - 1) / math.factorial(len(features))
                    phi[f] += w * (walk(tree, x, {*s, f}) - walk(tree, x, set(s)))
    return phi


@pytest.mark.parametrize("x,missing_left,want", [(0.2, True, -1), (0.5, True, -1), (0.7, True, 1), (None, True, -1), (None, False, 1)])
def test_stump(spark, x, missing_left, want):
    rows = spark.createDataFrame([(x,)], "f0 double")
    model = stump(missing_left)
    assert rows.select(T.raw_score_expression(model).alias("r")).first()["r"] == want
    assert rows.select(T.raw_score_vectorised(spark, model).alias("r")).first()["r"] == want


def test_expected_value_and_stump_attribution(spark):
    nodes = spark.createDataFrame([(0, 0, False, "f0", 0.5, True, 1, 2, None, 100.0), (0, 1, True, None, None, None, None, None, -1.0, 60.0), (0, 2, True, None, None, None, None, None, 1.0, 40.0)], T.NODE_SCHEMA)
    assert T.expected_value(nodes, 0.25).first()[0] == pytest.approx(0.05)
    model = T.load_ensemble(nodes)
    rows = spark.createDataFrame([(0.7,), (0.2,), (None,)], "f0 double")
    got = [r["contributions"][0]["contribution"] for r in T.with_attributions(rows, model).collect()]
    assert got == pytest.approx([1.2, -0.8, -0.8])


def test_both_forms_match_the_definition(spark):
    rng = random.Random(11)
    features = ["f0", "f1", "f2", "f3"]
    model = Ensemble([random_tree(rng, 4, features) for _ in range(4)], baseline=0.3)
    xs = [{f: (None if rng.random() < 0.2 else rng.random()) for f in features} for _ in range(40)]
    rows = spark.createDataFrame([(i, *[x[f] for f in features]) for i, x in enumerate(xs)], "i int, " + ", ".join(f"{f} double" for f in features))
    used = model.features
    both = rows.select("i", T.raw_score_expression(model).alias("a"), T.raw_score_vectorised(spark, model).alias("b"), T.attributions_vectorised(spark, model).alias("p"))
    by_expression = {r["i"]: {c["feature"]: c["contribution"] for c in r["contributions"]} for r in T.with_attributions(rows, model).collect()}
    expected = 0.3 + sum(walk(t, {}, set()) for t in model.trees)
    for r in both.collect():
        x = xs[r["i"]]
        raw = 0.3 + sum(walk(t, x) for t in model.trees)
        want = shapley(model, x, used)
        assert r["a"] == pytest.approx(raw, abs=1e-12) and r["b"] == pytest.approx(raw, abs=1e-12)
        assert [want[f] for f in used] == pytest.approx(list(r["p"]), abs=1e-9)
        assert want == pytest.approx(by_expression[r["i"]], abs=1e-9)
        assert sum(r["p"]) == pytest.approx(raw - expected, abs=1e-9)


def test_large_ensembles_take_the_vectorised_path(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_EXPRESSION_LEAVES", 1)
    model = stump()
    rows = T.with_attributions(T.with_probability(spark.createDataFrame([(0.7,)], "f0 double"), model), model)
    r = rows.first()
    assert r["score"] == pytest.approx(1 / (1 + math.exp(-1))) and r["contributions"][0]["contribution"] == pytest.approx(1.2)


def test_invalid_nodes(spark):
    good = [(0, 0, False, "f0", 0.5, True, 1, 2, None, 2.0), (0, 1, True, None, None, None, None, None, -1.0, 1.0), (0, 2, True, None, None, None, None, None, 1.0, 1.0)]
    check = lambda rows: [(r["tree_id"], r["node_id"], r["problem"]) for r in T.invalid_nodes(spark.createDataFrame(rows, T.NODE_SCHEMA), ["f0"]).collect()]
    assert check(good) == []
    assert check([(0, 0, False, "f0", 0.5, True, 0, 2, None, 2.0), *good[1:]]) == [(0, 0, "child")]
    assert check([(0, 0, False, "f0", 0.5, True, 1, 3, None, 2.0), *good[1:]]) == [(0, 0, "child")]
    assert check([(0, 0, False, "f9", 0.5, True, 1, 2, None, 2.0), *good[1:]]) == [(0, 0, "feature")]


def test_reasons_are_unique_sorted_and_capped(spark):
    parts = [("dti", 0.4, 30.0), ("dti_x_income", 0.9, 5.0), ("loan_amnt", 0.5, 1.0), ("term", 0.45, 60.0), ("fico_score", 0.1, None), ("annual_inc", -0.5, 9.0)]
    rows = spark.createDataFrame([(parts, d) for d in ("decline", "review", "approve")], "contributions array<struct<feature:string,contribution:double,value:double>>, decision string")
    got = {r["decision"]: r["adverse_actions"] for r in T.with_reasons(rows).collect()}
    assert [a["code"] for a in got["decline"]] == [2, 22, 21] and got["decline"][0]["shap_value"] == 0.9
    assert got["decline"][0]["feature_name"] == "Absolute Debt Burden" and got["decline"][2]["feature_value"] == 0.0
    assert got["review"] == got["decline"] and got["approve"] == []
    many = [(f, 1.0 - i / 10, 1.0) for i, f in enumerate(["dti", "term", "fico_score", "annual_inc", "purpose", "mystery"])]
    capped = T.with_reasons(spark.createDataFrame([(many, "decline")], rows.schema)).first()["adverse_actions"]
    assert len(capped) == 4
    unknown = T.with_reasons(spark.createDataFrame([([("mystery", 0.2, 1.0)], "decline")], rows.schema)).first()["adverse_actions"]
    assert (unknown[0]["code"], unknown[0]["reason"]) == (0, "mystery")


def test_covers_count_rows(spark, data):
    rows = V.model_input(spark, data)
    covers = {(r["tree_id"], r["node_id"]): r["cover"] for r in T.node_covers(rows, V.tree_nodes(spark)).collect()}
    n = rows.count()
    assert covers[(0, 0)] == covers[(1, 0)] == covers[(2, 0)] == n
    assert covers[(0, 1)] == covers[(0, 2)] + covers[(0, 3)]
    assert covers[(2, 4)] == rows.where("dti is null or dti > 60").count()


@pytest.mark.parametrize("n", [0, 1, 137, 5000])
def test_seeded_sample(spark, n):
    rows = spark.range(1000).withColumn("x", F.col("id") * 2)
    first = sorted(r["id"] for r in H.seeded_sample(rows, "id", n).collect())
    again = sorted(r["id"] for r in H.seeded_sample(rows.repartition(7), "id", n).collect())
    other = sorted(r["id"] for r in H.seeded_sample(rows, "id", n, seed=7).collect())
    assert first == again and len(first) == len(set(first)) == min(n, 1000)
    assert (first != other) == (0 < n < 1000)


@pytest.mark.parametrize("n, total", [(1, 3000), (10, 3000), (1700, 3000), (2999, 3000)])
def test_seeded_sample_is_the_first_rows_by_hash(spark, n, total):
    """By brute force: all hashes, sorted."""
    rows = spark.range(total).repartition(5).selectExpr("id", "id % 3 as other")
    hashed = sorted((r["h"], r["id"]) for r in rows.select("id", F.xxhash64(F.lit(42), F.col("id")).alias("h")).collect())
    # the order is that of the hash as an unsigned number
    unsigned = sorted((h % 2**64, i) for h, i in hashed)
    got = sorted(r["id"] for r in H.seeded_sample(rows, "id", n).collect())
    assert got == sorted(i for _, i in unsigned[:n])


def test_carve_out_is_exact_and_repeatable(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    first = M.carve_out(rows, "y", "id", 0.3)
    held = {r["y"]: r["n"] for r in first.where("held_out").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert held == {0: 450, 1: 150} and first.count() == 2000
    ids = lambda df: sorted(r["id"] for r in df.where("held_out").collect())
    assert ids(first) == ids(M.carve_out(rows.repartition(5), "y", "id", 0.3))
    both = M.early_stopping_rows(rows.where("id < 1500"), rows.where("id >= 1500"), "y", "id")
    assert both.where("held_out").count() == 500


def test_row_positions_are_a_permutation(spark):
    placed = H.row_positions(spark.range(500), "id", 3).collect()
    assert sorted(r["position"] for r in placed) == list(range(500)) and {r["size"] for r in placed} == {500}


# a quick fit for what does not depend on the model's size
SMALL = M.BoostingParameters(trees=6, depth=3, learning_rate=0.3, min_rows=5, bins=32)


@pytest.fixture(scope="module")
def signal(spark):
    rng = random.Random(21)
    rows = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        y = int(rng.random() < 1 / (1 + math.exp(-(6 * a - 3))))
        rows.append((i, None if rng.random() < 0.1 else a, b, y))
    return spark.createDataFrame(rows, "id bigint, a double, b double, y int").cache()


def test_training_export_and_importance(spark, signal):
    from riskframe.operators.ranking import roc_auc

    carved = M.carve_out(signal, "y", "id", 0.25)
    fitted = M.train_boosted(carved, ["a", "b"], "y", parameters=SMALL)
    nodes = M.export_nodes(spark, fitted)
    assert roc_auc(T.with_probability(signal, T.load_ensemble(nodes), "s"), "y", "s").first()["auc"] > 0.75
    assert M.verify_export(signal, fitted, nodes).first()["max_difference"] < 1e-9
    assert len(fitted.auc) == 6 and fitted.auc[fitted.trees - 1] == max(fitted.auc)
    kept = T.with_probability(signal.join(carved.where("held_out").select("id"), "id"), fitted.ensemble(spark), "s")
    assert roc_auc(kept, "y", "s").first()["auc"] == pytest.approx(max(fitted.auc), abs=2e-3)
    assert T.invalid_nodes(nodes, ["a", "b"]).count() == 0
    with pytest.raises(Exception, match="do not reproduce"):
        M.verify_export(signal, fitted, nodes.withColumn("value", F.col("value") * 1.1)).collect()
    ensemble = T.load_ensemble(nodes)
    found = {r["feature"]: r["importance"] for r in M.permutation_importance(signal, ensemble, ["a", "b"], "y", "id", repeats=3).collect()}
    assert found["a"] > 0.1 and abs(found["b"]) < found["a"] / 3


def test_pseudo_rows_never_reach_calibration(spark, signal):
    rejected = signal.limit(200).select((F.col("id") + 5000).alias("id"), (F.col("a") + 1000).alias("a"), (F.col("b") + 1000).alias("b"))
    scored = M.pseudo_labels(rejected.withColumn("s", F.col("b")), "s", 0.4)
    labelled = scored.withColumnRenamed("default", "y")
    assert labelled.where("y = 1").count() == 80
    _, observed = M.train_augmented(signal.where("id < 700"), labelled, signal.where("id >= 700"), ["a", "b"], "y", "id", SMALL)
    assert observed.count() > 0 and observed.where("b > 900").count() == 0


def test_pseudo_label_threshold_matches_numpy(spark):
    rng = random.Random(2)
    xs = [round(rng.random(), 2) for _ in range(301)]
    got = M.pseudo_labels(spark.createDataFrame([(x,) for x in xs], "s double"), "s", 0.37).agg(F.sum("default")).first()[0]
    assert got == int((np.array(xs) >= np.percentile(xs, 63)).sum())


def test_reject_rate_is_doubled_and_capped(spark):
    rate = lambda ones: M.reject_rate(spark.range(10).select((F.col("id") < ones).cast("int").alias("default"))).first()["rate"]
    assert rate(2) == pytest.approx(0.4) and rate(9) == 0.6


def test_align_rejected(spark):
    train = spark.createDataFrame([(1.0, 10.0), (3.0, 20.0), (5.0, 60.0)], "a double, b double")
    rejected = spark.createDataFrame([(1, 9.0, 7.0), (2, None, 7.0)], "id int, a double, other double")
    got = {r["id"]: (r["a"], r["b"]) for r in M.align_rejected(rejected, train, ["a", "b"], "id").collect()}
    assert got == {1: (9.0, 20.0), 2: (3.0, 20.0)}


def test_scoring_job_sorts_out_failures(spark):
    from riskframe.plans.scoring import errors, results, score_requests, scored_table, write_scored, written_errors, written_results
    from riskframe.session import scratch_path

    now = datetime(2024, 2, 15)
    old = datetime(2024, 1, 1)
    store = spark.createDataFrame(
        [("ok", 1, now, {"f0": 0.7}), ("null", 1, now, {"f0": None}), ("stale", 1, old, {"f0": 0.7}), ("other", 2, now, {"f0": 0.7}), ("absent", 1, now, {"x": 0.7})],
        "applicant_id string, feature_version int, computed_at timestamp, features map<string,double>").withColumns(
        {"data_completeness": F.lit(1.0), "fico_score": F.lit(700), "grade": F.lit(2)})
    ids = ["ok", "null", "stale", "other", "absent", "nobody", "bad id", ""]
    requests = spark.createDataFrame([(str(i), a) for i, a in enumerate(ids)], "request_id string, applicant_id string")
    done = score_requests(requests, store, stump(), None, F.lit(now).cast("timestamp"), "v1", 1)
    good = {r["applicant_id"]: r for r in results(done).collect()}
    assert set(good) == {"ok", "null"} and good["ok"]["decision"] == "decline" and good["ok"]["score"] == round(1 / (1 + math.exp(-1)), 5)
    assert good["ok"]["calibrated_pd"] is None and good["ok"]["adverse_actions"][0]["shap_value"] == 1.2
    bad = {r["applicant_id"]: r["error"] for r in errors(done).collect()}
    assert bad["stale"] == "stale" and bad["other"] == "version_missing" and bad["absent"] == "feature_missing" and bad["nobody"] == "not_found"
    assert "only letters" in bad["bad id"] and bad[""] == "applicant_id is required"

    table = scored_table(spark, scratch_path(spark, "scored"))
    assert write_scored(table, done, batch=3) and not write_scored(table, done, batch=3) and not write_scored(table, done, batch=2)
    assert sorted(written_results(table).drop("feature_snapshot").collect()) == sorted(results(done).drop("feature_snapshot").collect())
    assert sorted(written_errors(table).collect()) == sorted(errors(done).collect())
    assert table.manifest().number == 1 and write_scored(table, results(done).withColumn("error", F.lit(None).cast("string")), batch=4)
    assert written_results(table).count() == 4 and written_errors(table).count() == 6


def test_importance_scores_every_permuted_row_once_and_ranks_ties_exactly(spark, signal, monkeypatch):
    from riskframe.operators.bitscore import Scorer
    from riskframe.operators.history import row_positions

    node = lambda f, t, left, right: T.Node(f, t, True, left, right, None, 1.0)
    leaf = lambda v: T.Node(None, None, None, None, None, v, 1.0)
    model = T.Ensemble([{0: node("b", 0.0, 1, 2), 1: leaf(-0.5), 2: leaf(0.25)}, {0: node("a", 0.2, 1, 2), 1: node("b", -0.3, 3, 4), 2: leaf(0.5), 3: leaf(-1.0), 4: leaf(0.0)}], 0.0)
    monkeypatch.setattr(M, "COUNTED_ROWS", 50)
    made = M.permutation_importance(signal, model, ["a", "unused", "b"], "y", "id", repeats=2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan and "Generate" not in plan
    scorer, order, want = Scorer(model.trees, model.features, 0.0), model.features, {f: 0.0 for f in ("a", "unused", "b")}

    def auc(score, y):
        gap = score[y == 1][:, None] - score[y == 0][None, :]
        return ((gap > 0) + (gap == 0) / 2).mean()

    for seed in (42, 43):
        rows = row_positions(signal.select("id", "y", "a", "b"), "id", seed).orderBy("position").toPandas()
        x, y = rows[order].to_numpy(float, na_value=float("nan")), rows["y"].to_numpy()
        raws = scorer.raw_with_donors(x, x[[len(x) - 1, *range(len(x) - 1)]])
        for k, f in enumerate(order):
            want[f] += (auc(raws[:, 0], y) - auc(raws[:, 1 + k], y)) / 2
    assert {r["feature"]: r["importance"] for r in made.collect()} == pytest.approx(want, abs=1e-12)
