"""Boosted trees: splits and whole trees against brute force, all ways of growing alike, the shipped parameter sets."""

import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import boosting as B, training as M, trees as T
from riskframe.operators.ranking import roc_auc


def table(spark, n, seed, features=4, missing=0.15, partitions=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features)).round(2)
    z = x[:, 0] + np.sin(2 * x[:, 1]) + (x[:, 2] * x[:, 3] if features > 3 else 0)
    hole = rng.random((n, features)) < missing
    z = z + 0.8 * hole[:, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    x[hole] = np.nan
    names = [f"x{k}" for k in range(features)]
    frame = spark.createDataFrame(pd.DataFrame({"id": range(n), **{c: x[:, k] for k, c in enumerate(names)}, "y": y, "w": rng.random(n) + 0.5}))
    return x, y, names, frame.repartition(partitions, "id").withColumn("held_out", F.lit(False))


def plain_tree(x, y, w, thresholds, p):
    """Best leaf first over the rows themselves: the leaf value of every row of one tree that starts at the mean."""
    share = (w * y).sum() / w.sum()
    g, h = w * (share - y), w * share * (1 - share)

    def value(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + p.ridge)

    def split(rows, depth):
        best = (0.0, None)
        if depth == p.depth:
            return best
        for f in range(x.shape[1]):
            for t in [*thresholds[f], math.inf]:
                for missing_left in (False, True):
                    left = rows & (np.isnan(x[:, f]) & missing_left | (x[:, f] <= t))
                    right = rows & ~left
                    if left.sum() >= p.min_rows and right.sum() >= p.min_rows:
                        gain = value(left) + value(right) - value(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
        return best

    out, leaves = np.zeros(len(y)), 1
    root = np.ones(len(y), bool)
    gain, parts = split(root, 0)
    open_, final = [(-gain, 0, root, 0, parts)], []
    number = 1
    while open_:
        gain, _, rows, depth, parts = heapq.heappop(open_)
        if parts is None or leaves >= p.leaves:
            final.append(rows)
            continue
        leaves += 1
        for side in parts:
            sub, cut = split(side, depth + 1)
            heapq.heappush(open_, (-sub, number, side, depth + 1, cut))
            number += 1
    for rows in final:
        out[rows] = -p.learning_rate * g[rows].sum() / (h[rows].sum() + p.ridge)
    return out + math.log(share / (1 - share))


@pytest.mark.parametrize("parameters, weight", [
    (M.BoostingParameters(1, 3, 0.5, 5, 12, leaves=5), None), (M.BoostingParameters(1, 4, 0.1, 12, 255, leaves=9, ridge=3.0), "w"), (M.BoostingParameters(1, 1, 1.0, 1, 2), None),
])
def test_one_tree_by_brute_force(spark, parameters, weight):
    x, y, names, frame = table(spark, 240, 4)
    fitted = M.train_boosted(frame, names, "y", parameters=parameters, weight=weight)
    w = np.array([r.w for r in frame.orderBy("id").collect()]) if weight else np.ones(len(y))
    want = plain_tree(x, y, w, [list(t) for t in fitted.bins.thresholds], parameters)
    got = {r.id: r.s for r in T.with_raw_score(frame, fitted.ensemble(), "s").collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(want.tolist(), abs=1e-9)
    tree = fitted.grown[0]
    assert (tree.feature < 0).sum() <= parameters.leaves and tree.cover[0] == len(y) and tree.cover[tree.feature < 0].sum() == len(y)


def same(a, b):
    return len(a.grown) == len(b.grown) and all(
        (s.feature == t.feature).all() and (s.bin == t.bin).all() and (s.missing_left == t.missing_left).all() and np.allclose(s.value, t.value, atol=1e-12)
        for s, t in zip(a.grown, b.grown)
    )


def test_leaves_grow_alike_in_tasks_and_by_summed_histograms(spark, monkeypatch):
    _, _, names, frame = table(spark, 900, 5, partitions=5)
    parameters = M.BoostingParameters(3, 4, 0.3, 8, 40, leaves=11)
    fits = []
    for rows in (10**6, 200, 1):  # whole trees in one task, mixed, every level by Spark
        monkeypatch.setattr(B, "IN_TASK_ROWS", rows)
        fits.append(M.train_boosted(frame, names, "y", parameters=parameters))
    assert same(fits[0], fits[1]) and same(fits[0], fits[2])
    assert max((t.feature < 0).sum() for t in fits[0].grown) == 11


def test_scores_survive_the_windows(spark, monkeypatch):
    _, _, names, frame = table(spark, 400, 6)
    parameters = M.BoostingParameters(7, 3, 0.3, 5, 30)
    fits = []
    for window in (100, 2):
        monkeypatch.setattr(B, "WINDOW", window)
        fits.append(M.train_boosted(frame.withColumn("held_out", F.col("id") % 4 == 0), names, "y", parameters=parameters))
    assert same(*fits) and fits[0].auc == pytest.approx(fits[1].auc) and len(fits[0].auc) == 7
    assert fits[0].auc[fits[0].trees - 1] == max(fits[0].auc)


def test_missing_values_learn_their_side(spark):
    n = 400
    rows = [(i, None if i % 4 == 0 else float(i % 7), int(i % 4 == 0 or i % 7 > 4), 0) for i in range(n)]
    frame = spark.createDataFrame(rows, "id int, x double, y int, other int").withColumn("held_out", F.lit(False))
    fitted = M.train_boosted(frame, ["x", "other"], "y", parameters=M.BoostingParameters(1, 2, 1.0, 5, 20))
    root = fitted.nodes(spark).where("node_id = 0").first()
    assert (root.feature, root.threshold, root.missing_left) == ("x", 4.0, False)
    alone = spark.createDataFrame([(i, None if i % 2 else 1.0, i % 2) for i in range(100)], "id int, x double, y int").withColumn("held_out", F.lit(False))
    fitted = M.train_boosted(alone, ["x"], "y", parameters=M.BoostingParameters(1, 2, 1.0, 5, 20))
    score = {r.x: r.s for r in T.with_raw_score(alone, fitted.ensemble(), "s").collect()}
    assert score[None] > 0 > score[1.0]  # the split that only parts missing values
    nan = alone.withColumn("x", F.coalesce("x", F.lit(float("nan"))))
    assert same(fitted, M.train_boosted(nan, ["x"], "y", parameters=M.BoostingParameters(1, 2, 1.0, 5, 20)))


def test_odd_inputs(spark):
    _, _, names, frame = table(spark, 60, 7)
    parameters = M.BoostingParameters(3, 3, 0.3, 5, 30)
    empty = M.train_boosted(frame.where("false"), names, "y", parameters=parameters)
    assert [len(t.feature) for t in empty.grown] == [1] and empty.auc == [] and empty.ensemble().leaf_count == 1
    one = M.train_boosted(frame.withColumn("y", F.lit(1)), names, "y", parameters=parameters)
    assert one.ensemble().trees[0][0].value > 10
    none = M.train_boosted(frame, [], "y", parameters=parameters)
    assert none.ensemble().leaf_count == 1 and none.nodes(spark).count() == 1
    unlabelled = frame.unionByName(frame.withColumn("y", F.lit(None).cast("int")))
    assert same(M.train_boosted(frame, names, "y", parameters=parameters), M.train_boosted(unlabelled, names, "y", parameters=parameters))
    infinite = frame.withColumn("x0", F.when(F.col("id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("x0")))
    fitted = M.train_boosted(infinite, names, "y", parameters=parameters)
    assert M.verify_export(infinite, fitted, fitted.nodes(spark)).first()["max_difference"] < 1e-12
    with pytest.raises(ValueError):
        M.BoostingParameters(10, 3, 0.1, 5, bins=256)
    with pytest.raises(ValueError):
        M.train_boosted(frame, names * 5000, "y", parameters=M.BoostingParameters(1, 20, 0.1, 5))


@pytest.fixture(scope="module")
def smooth(spark):
    """A smooth target of eight inputs, some values missing: small steps go on paying."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 8))
    z = x[:, 0] + np.sin(2 * x[:, 1]) + x[:, 2] * x[:, 3] + 0.5 * np.abs(x[:, 4])
    y = (rng.random(1500) < 1 / (1 + np.exp(-z))).astype(int)
    x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"x{k}" for k in range(8)]
    frame = spark.createDataFrame(pd.DataFrame({"id": range(1500), **{c: x[:, k] for k, c in enumerate(names)}, "y": y}))
    return names, M.carve_out(frame, "y", "id", 0.3).cache()


@pytest.mark.parametrize("parameters", [M.CHAMPION, M.CHALLENGER], ids=["champion", "challenger"])
def test_shipped_parameters_keep_many_trees(spark, smooth, parameters):
    names, carved = smooth
    fitted = M.train_boosted(carved, names, "y", parameters=parameters)
    assert fitted.trees > 50 and fitted.trees + parameters.patience <= len(fitted.auc) < parameters.trees
    held = T.with_probability(carved.where("held_out"), fitted.ensemble(), "s")
    auc = roc_auc(held, "y", "s").first()["auc"]
    assert auc == pytest.approx(max(fitted.auc), abs=2e-3) and auc > fitted.auc[0] + 0.02
    nodes = fitted.nodes(spark)
    assert nodes.select("tree_id").distinct().count() == fitted.trees and T.invalid_nodes(nodes, names).count() == 0
    assert nodes.where("missing_left = false").count() > 0 and nodes.where("missing_left").count() > 0
    assert M.verify_export(carved, fitted, nodes).first()["max_difference"] < 1e-9
    if parameters is M.CHAMPION:
        assert auc >= mllib_auc(carved, names) - 1e-3


def mllib_auc(carved, names):
    """The held-out AUC of the library's own boosted trees, at as many trees as they need here."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = carved.fillna(-1e9, names).withColumn("label", F.col("y").cast("double"))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(filled)
    best = 0.0
    model = GBTClassifier(maxIter=60, maxDepth=4, stepSize=0.1, minInstancesPerNode=20, maxBins=255, seed=1).fit(rows.where("not held_out"))
    scored = model.transform(rows.where("held_out")).select("y", F.get(vector_to_array("probability"), F.lit(1)).alias("s"))
    best = max(best, roc_auc(scored, "y", "s").first()["auc"])
    return best


def test_a_window_of_trees_is_grown_on_held_blocks(spark, monkeypatch):
    x, y, names, rows = table(spark, 3000, 5)
    plans, plain = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **k: plans.append(1) or plain(self, *a, **k))
    monkeypatch.setattr(B, "IN_TASK_ROWS", 500)
    found = []
    for collected in (32, 0):
        monkeypatch.setattr(B, "COLLECTED_TASKS", collected)
        plans.clear()
        fitted = M.train_boosted(rows, names, "y", parameters=B.BoostingParameters(6, 4, 0.3, 20))
        assert len(fitted.grown) == 6 and len(plans) <= 4  # both sides' blocks and the held-out counts, not every level of every tree
        found.append([(r["tree_id"], r["node_id"], r["threshold"], r["value"]) for r in M.export_nodes(spark, fitted).collect()])
    assert found[0] == found[1]


def test_features_of_few_bins_are_counted_together():
    """The sums of every bin are those of each feature alone, in far fewer passes over the rows."""
    rng = np.random.default_rng(3)
    sizes = [256, 5, 4, 4, 100, 2, 3, 256, 7]
    bins = B.Bins([f"f{k}" for k in range(len(sizes))], [np.arange(n - 2.0) for n in sizes])
    joint = B.Joint.of(bins)
    assert sorted(f for g in joint.groups for f in g) == list(range(len(sizes))) and len(joint.groups) == 4
    assert max(joint.cells(g) for g in joint.groups) <= B.JOINT_CELLS
    x = np.stack([np.where(rng.random(500) < 0.1, bins.missing, rng.integers(0, n - 1, 500)) for n in sizes]).astype(np.uint8)
    g, h = rng.normal(size=500), rng.random(500)
    rows = [(0, np.arange(0, 300, 2)), (1, np.array([], int)), (2, np.arange(301, 500))]
    total, order = joint.empty(3), np.concatenate([r for _, r in rows])
    joint.add(total, x, g[order], h[order], rows)
    made = joint.histograms(total, 3)
    for slot, at in rows:
        for f in range(len(sizes)):
            for k, weight in enumerate((g[at], h[at], None)):
                assert made[slot, f, :, k] == pytest.approx(np.bincount(x[f, at], weight, bins.missing + 1), abs=1e-12)


def test_open_leaves_are_sent_to_tasks_only_when_few_rows_are_left(spark, monkeypatch):
    """All rows of a large table do not move for every tree."""
    _, _, names, frame = table(spark, 3000, 9)
    sent, plain = [], B._finished
    monkeypatch.setattr(B, "_finished", lambda *a: sent.append(sum(a[3].sums[at][2] for at in a[4])) or plain(*a))
    monkeypatch.setattr(B, "IN_TASK_ROWS", 1400)
    M.train_boosted(frame, names, "y", parameters=M.BoostingParameters(3, 5, 0.3, 20))
    assert all(n <= 1400 for n in sent)
    assert [B.block_tasks(n, 8) for n in (1400, 1401, 8 * 64 * 32_768, 8 * 64 * 32_768 + 1)] == [1, 8, 8, 16]


def test_bins_are_quantiles_however_the_rows_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(10)
    values = np.concatenate([rng.normal(size=6000), np.full(3000, 0.5), [np.nan] * 500, [math.inf] * 20])
    frame = spark.createDataFrame(pd.DataFrame({"x": values, "few": np.arange(len(values)) % 3.0})).withColumn("none", F.lit(None).cast("double"))
    ranked = np.sort(values[~np.isnan(values)])
    want = np.unique([ranked[math.ceil(len(ranked) * i / 20) - 1] for i in range(1, 20)])
    monkeypatch.setattr(B, "SKETCH_ROWS", 10**6)
    monkeypatch.setattr(B, "SKETCH_POINTS", 10**4)
    exact = B.fit_bins(frame.repartition(7), ["x", "few", "none"], 20)
    assert exact.thresholds[0].tolist() == want.tolist() and exact.thresholds[1].tolist() == [0.0, 1.0, 2.0] and len(exact.thresholds[2]) == 0
    monkeypatch.setattr(B, "SKETCH_ROWS", 500)
    monkeypatch.setattr(B, "SKETCH_POINTS", 64)
    thinned = B.fit_bins(frame.repartition(7), ["x"], 20).thresholds[0]
    for t in thinned:  # within the promised ranks of a wanted quantile
        low, high = np.searchsorted(ranked, t, "left"), np.searchsorted(ranked, t, "right")
        assert any(low - len(ranked) * 3 / 1280 <= len(ranked) * i / 20 <= high + len(ranked) * 3 / 1280 for i in range(1, 20))
    assert len(thinned) == len(want)


def test_walking_by_levels_ends_in_the_same_leaves():
    """All columns move a level at a time, with as many steps as levels, not one for each node."""
    rng = np.random.default_rng(11)
    x, g = rng.integers(0, 21, (4, 3000)).astype(np.uint8), rng.normal(size=3000)
    bins = B.Bins([f"f{k}" for k in range(4)], [np.arange(19.0)] * 4)
    tree = B.grown_in_task(x, g, np.ones(3000), B.Joint.of(bins), M.BoostingParameters(1, 5, 0.1, 5, 20), 5).tree(M.BoostingParameters(1, 5, 0.1, 5, 20))
    at = tree.walked(x, bins.missing)
    assert len(tree.feature) > 20 and (tree.feature[at] < 0).all() and tree.missing_left.any()
    for leaf, rows in tree.reached(x, bins.missing):
        assert (at[rows] == leaf).all() and len(rows) == tree.cover[leaf] == (at == leaf).sum()


def test_the_model_query_ranks_stored_scores(spark, monkeypatch):
    from checks import q_model as QM

    data = "/root/testdata/sf0.001"
    rows = QM.labelled(spark, data).withColumn("held_out", F.lit(False))
    fitted = M.train_boosted(rows, QM.MODEL_FEATURES, "default", parameters=M.BoostingParameters(2, 3, 0.3, 10, leaves=5))
    monkeypatch.setattr(QM, "trained", lambda spark, d: fitted)
    made = QM.boosted_trees(spark, data)
    scans = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Location:" in line]
    assert scans and all("boosted-scores" in line for line in scans)
    again = roc_auc(T.with_probability(rows, fitted.ensemble(), "score"), "default", "score", ["split"]).collect()
    assert {r["split"]: r["auc"] for r in made.collect()} == pytest.approx({r["split"]: r["auc"] for r in again})
