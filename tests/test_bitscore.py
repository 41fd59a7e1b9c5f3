"""Bit-mask scoring and attributions against walking every tree; both scoring forms on missing and infinite inputs."""

import numpy as np
import pytest

from riskframe.operators.bitscore import Attributions, Scorer, _others
from riskframe.operators.trees import Ensemble, Node, _leaves, raw_score_expression, raw_score_vectorised, with_donors


def grown(rng, depth, features, levels=255):
    nodes = {}

    def build(d):
        k = len(nodes)
        nodes[k] = None
        if d == 0 or d < depth and rng.random() < 0.05:
            nodes[k] = Node(None, None, None, None, None, float(rng.normal()), float(rng.integers(1, 50)))
        else:
            name, cut, missing = f"f{rng.integers(features)}", float(rng.integers(0, levels)) / levels, bool(rng.random() < 0.5)
            left, right = build(d - 1), build(d - 1)
            nodes[k] = Node(name, cut, missing, left, right, None, nodes[left].cover + nodes[right].cover)
        return k

    build(depth)
    return nodes


def walked(tree, row, features):
    at = 0
    while not tree[at].is_leaf:
        n = tree[at]
        v = row[features.index(n.feature)]
        at = n.left if (n.missing_left if np.isnan(v) else v <= n.threshold) else n.right
    return tree[at].value


@pytest.fixture(params=[(3, 5, 4), (6, 130, 33), (9, 3, 20), (12, 2, 40)], ids=str)
def case(request):
    depth, trees, features = request.param
    rng = np.random.default_rng(depth)
    forest = [grown(rng, depth, features) for _ in range(trees)]
    names = Ensemble(forest, 0.0).features
    x = rng.random((300, len(names)))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[0], x[1] = np.inf, -np.inf
    return forest, names, x, rng


def test_scores_equal_walking(case):
    forest, names, x, rng = case
    scorer = Scorer(forest, names, 0.3)
    want = np.array([0.3 + sum(walked(t, r, names) for t in forest) for r in x])
    assert scorer.raw(x) == pytest.approx(want)
    donor = rng.permutation(x)
    swapped = scorer.raw_with_donors(x, donor)
    assert swapped[:, 0] == pytest.approx(want)
    for k in (0, len(names) - 1):
        y = x.copy()
        y[:, k] = donor[:, k]
        assert swapped[:, 1 + k] == pytest.approx(scorer.raw(y))


def test_attributions_add_up(case):
    forest, names, x, _ = case
    x = x[:40]
    phi = Attributions(forest, names).of(x)
    base = sum(sum(n.value * n.cover for n in t.values() if n.is_leaf) / t[0].cover for t in forest)
    assert phi.sum(axis=1) + base == pytest.approx(Scorer(forest, names, 0.0).raw(x))


@pytest.mark.parametrize("bits", [0, 1, 3, 8])
def test_attributions_equal_a_sum_over_leaves(case, bits):
    """Branch tables of any size give what the polynomials of the single leaves give."""
    forest, names, x, _ = case
    forest, x = forest[:3], x[:25]
    want = np.zeros((len(x), len(names)))
    for tree in forest:
        for leaf in _leaves(tree):
            agree = np.ones((len(x), len(leaf.features)))
            for k, tests in enumerate(leaf.tests):
                for node, left in tests:
                    v = x[:, names.index(node.feature)]
                    agree[:, k] *= np.where(np.isnan(v), node.missing_left, v <= node.threshold) == left
            share = np.array(leaf.share)
            for k, f in enumerate(leaf.features):
                want[:, names.index(f)] += leaf.value * (agree[:, k] - share[k]) * _others(agree, share[None], k)
    assert Attributions(forest, names, bits).of(x) == pytest.approx(want, abs=1e-9)


def test_both_forms_on_missing_and_infinite_inputs(spark):
    rng = np.random.default_rng(4)
    model = Ensemble([grown(rng, 3, 3, 7) for _ in range(4)], -0.5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 3 / 7, 1.0]
    rows = [(a, b, c) for a in odd for b in odd[:5] for c in odd[1:4]]
    frame = spark.createDataFrame(rows, "f0 double, f1 double, f2 double")
    both = frame.select(raw_score_expression(model).alias("a"), raw_score_vectorised(spark, model).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b) for r in both)
    clean = [[np.nan if v is None else v for v in r] for r in rows]
    want = sorted(-0.5 + sum(walked(t, r, ["f0", "f1", "f2"]) for t in model.trees) for r in clean)
    assert sorted(r.b for r in both) == pytest.approx(want)


def test_donors_through_spark(spark):
    rng = np.random.default_rng(5)
    model = Ensemble([grown(rng, 3, 2) for _ in range(3)], 0.0)
    frame = spark.createDataFrame([(0.2, 0.9, 0.8, 0.1)], "f0 double, f1 double, donor_f0 double, donor_f1 double")
    got = frame.select(with_donors(model, ["f0", "f1"]).alias("x")).first().x
    score = lambda *r: sum(walked(t, r, ["f0", "f1"]) for t in model.trees)
    assert got == pytest.approx([score(0.2, 0.9), score(0.8, 0.9), score(0.2, 0.1)])
