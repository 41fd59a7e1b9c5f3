"""Order statistics, ranking, shift and calibration against brute force and hand values."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions.binning import linspace
from riskframe.functions.scorecard import calibrated
from riskframe.operators import calibration as C, distributions as S, eda as E, order, ranking as R


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(spark, xs):
    return frame(spark, [(None if x is None else float(x),) for x in xs], "v double")


def pairs(spark, ys, ss):
    return frame(spark, [(int(y), float(s)) for y, s in zip(ys, ss)], "y int, s double")


def test_histogram_edges(spark):
    cases = {(0.5, 1.5, 2.5): [1, 1, 1], (0, 1, 2): [1, 1, 1], (3, 3): [0, 0, 2], (-0.1, 3.5): [0, 0, 0], (float("nan"), 0.5): [1, 0, 0]}
    for xs, want in cases.items():
        got = {r["bin"]: r["count"] for r in S.histogram(values(spark, xs), "v", [0.0, 1.0, 2.0, 3.0]).collect()}
        assert [got[i] for i in range(3)] == want


@pytest.mark.parametrize("q,want", [(0.0, 1), (1.0, 5), (0.5, 3), (0.25, 2), (0.1, 1.4)])
def test_quantile_values(spark, q, want):
    assert order.exact_quantiles(values(spark, [5, 3, 1, 2, 4]), "v", [q]).first()["quantiles"][0] == pytest.approx(want)


def test_quantile_of_one_value(spark):
    assert order.exact_quantiles(values(spark, [7]), "v", [0.0, 0.3, 1.0]).first()["quantiles"] == [7.0] * 3
    assert order.exact_quantiles(values(spark, [None, None]), "v", [0.5]).collect() == []


@pytest.mark.parametrize("n_ranges", [9, 200, 4096])
def test_quantiles_match_numpy_with_a_hot_value(spark, n_ranges):
    rng = random.Random(3)
    xs = [0.25] * 400 + [rng.gauss(0, 1) for _ in range(700)] + [round(rng.random(), 1) for _ in range(300)]
    qs = [i / 20 for i in range(21)]
    got = order.exact_quantiles(values(spark, xs), "v", qs, n_ranges=n_ranges).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(xs, qs), rtol=0, atol=1e-12)


@pytest.mark.parametrize("n_ranges", [9, 400])
def test_grouped_quantiles_and_running_sums(spark, n_ranges):
    rng = random.Random(5)
    rows = [(g, float(rng.randrange(60))) for g in "abc" for _ in range({"a": 500, "b": 30, "c": 1}[g])]
    df = frame(spark, rows, "g string, v double")
    for limit in (3, None):
        got = {r["g"]: r["quantiles"] for r in order.exact_quantiles(df, "v", [0.1, 0.5, 0.99], ["g"], group_limit=limit, n_ranges=n_ranges).collect()}
        for g in "abc":
            np.testing.assert_allclose(got[g], np.quantile([v for h, v in rows if h == g], [0.1, 0.5, 0.99]))
        sums = order.running_sums(order.value_counts(df, "v", ["g"]), "v", ["n"], ["g"], limit, n_ranges).collect()
        for r in sums:
            mine = [v for h, v in rows if h == r["g"]]
            assert r["n_before"] == sum(v < r["v"] for v in mine) and r["n_total"] == len(mine)


@pytest.mark.parametrize("ys,ss,want", [
    ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], 1.0), ([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9], 0.0), ([0, 0, 1, 1], [0.3, 0.5, 0.5, 0.9], 0.875),
    ([0, 1, 0, 1], [0.5] * 4, 0.5), ([1, 1], [0.1, 0.2], None)])
def test_auc(spark, ys, ss, want):
    assert R.roc_auc(pairs(spark, ys, ss), "y", "s").first()["auc"] == want


@pytest.mark.parametrize("ys,ss,want", [
    ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], 1.0), ([0, 1, 0, 1], [0.5] * 4, 0.0), ([0, 1, 0, 1], [0.2, 0.4, 0.6, 0.8], 0.5), ([1, 0, 1, 0], [0.1, 0.9, 0.2, 0.8], 0.0)])
def test_ks(spark, ys, ss, want):
    assert R.ks_statistic(pairs(spark, ys, ss), "y", "s").first()["ks"] == pytest.approx(want)


def test_auc_of_reversed_scores_and_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.3, round(rng.random(), 2)) for _ in range(400)] + [(True, 0.5)] * 150
    df = frame(spark, [(int(y), s, -s) for y, s in rows], "y int, s double, r double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert R.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(brute, abs=1e-12)
    assert R.roc_auc(df, "y", "r").first()["auc"] == pytest.approx(1 - brute, abs=1e-12)


def test_curves_end_where_they_should(spark):
    df = pairs(spark, [0, 1, 0, 1, 1], [0.1, 0.4, 0.4, 0.8, 0.9])
    roc = sorted((r["fpr"], r["tpr"]) for r in R.roc_points(df, "y", "s").collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0) and len(roc) == 5
    pr = {(round(r["recall"], 6), round(r["precision"], 6)) for r in R.precision_recall_points(df, "y", "s").collect()}
    assert (0.0, 1.0) in pr and (1.0, 0.6) in pr and (1.0, 0.75) in pr


def decile_rows(spark, defaults):
    rows = [(1 if i < d else 0, float(10 * k + i)) for k, d in enumerate(defaults) for i in range(10)]
    return pairs(spark, *zip(*rows))


def test_deciles_and_breaks(spark):
    table = R.score_deciles(decile_rows(spark, range(10)), "y", "s")
    rows = sorted(table.collect(), key=lambda r: r["decile"])
    assert [r["count"] for r in rows] == [10] * 10
    assert [r["default_rate"] for r in rows] == [d / 10 for d in range(10)]
    assert R.rank_order_breaks(table).first()[0] == 0
    swapped = R.score_deciles(decile_rows(spark, [0, 1, 2, 4, 3, 5, 6, 7, 8, 9]), "y", "s")
    assert R.rank_order_breaks(swapped).first()[0] == 1


def test_deciles_of_few_values(spark):
    assert R.score_deciles(pairs(spark, [0, 1] * 10, [0.5] * 20), "y", "s").count() == 0
    two = R.score_deciles(pairs(spark, [0] * 50 + [1] * 50, [0.2] * 50 + [0.8] * 50), "y", "s").collect()
    assert sorted(r["count"] for r in two) == [50, 50]


@pytest.mark.parametrize("n", [10, 37, 100, 1003])
def test_gains_against_sorted_rows(spark, n):
    rng = random.Random(n)
    rows = [(i, int(rng.random() < 0.3), 0.4 if rng.random() < 0.4 else round(rng.random(), 1)) for i in range(n)]
    got = {r["decile"]: r for r in R.gains_table(frame(spark, rows, "id int, y int, s double"), "y", "s", "id").collect()}
    want = {k: [] for k in range(1, 11)}
    edges = [1 + (n - 1) * k / 10 for k in range(11)]
    for rank, row in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1):
        k = next(k for k in range(1, 11) if rank <= edges[k] + 1e-9)
        want[k].append(row)
    running = 0
    for k, members in want.items():
        running += sum(m[1] for m in members)
        assert got[k]["count"] == len(members) and got[k]["cumulative_defaults"] == running
        assert got[k]["min_score"] == min(m[2] for m in members) and got[k]["max_score"] == max(m[2] for m in members)


def test_smoothed_shares(spark):
    for xs, want in (([], [0.5, 0.5]), ([0.1] * 8, [0.9, 0.1])):
        got = sorted((r["bin"], r["share"]) for r in S.smoothed_shares(S.histogram(values(spark, xs), "v", [0.0, 0.5, 1.0])).collect())
        assert [s for _, s in got] == pytest.approx(want)


def psi(spark, a, b, **options):
    return S.psi(values(spark, a), values(spark, b), "v", **options).first()["psi"]


def test_psi(spark):
    low, high = [0.1 + i / 1000 for i in range(100)], [0.8 + i / 1000 for i in range(100)]
    assert psi(spark, low, low) == 0
    assert psi(spark, low, high) > 0.25
    assert math.isfinite(psi(spark, low, []))
    assert psi(spark, low, low, smoothing="clip") == 0
    e, a = np.histogram(low, 10, (0, 1))[0] / 100, np.histogram(high, 10, (0, 1))[0] / 100
    e, a = np.clip(e, 1e-6, None), np.clip(a, 1e-6, None)
    assert psi(spark, low, high, smoothing="clip") == pytest.approx(float(np.sum((a - e) * np.log(a / e))))


def brute_csi(train, prod, bins=10):
    train, prod = [x for x in train if x is not None], [x for x in prod if x is not None]
    if not train + prod:
        return 0.0
    edges = np.unique(np.quantile(train + prod, [i / bins for i in range(bins + 1)]))
    if len(edges) < 2:
        return 0.0
    shares = [(np.histogram(side, edges)[0] + 1) / (len(side) + len(edges) - 1) for side in (train, prod)]
    return float(np.sum((shares[1] - shares[0]) * np.log(shares[1] / shares[0])))


def test_csi_of_many_shapes(spark):
    rng = random.Random(9)
    n = 200
    train = {
        "same": [float(i) for i in range(n)], "moved": [float(i) for i in range(n)], "empty": [None] * n, "constant": [3.0] * n,
        "gaps": [float(i) if i % 3 else None for i in range(n)], "ties": [float(rng.randrange(3)) for _ in range(n)], "gauss": [rng.gauss(0, 1) for _ in range(n)],
    }
    prod = dict(train, moved=[i + 150.0 for i in range(n)], ties=[float(rng.randrange(4)) for _ in range(n)], gauss=[rng.gauss(0.5, 2) for _ in range(n)])
    names = list(train)
    a, b = (frame(spark, list(zip(*side.values())), ", ".join(f"{c} double" for c in names)) for side in (train, prod))
    got = {r["feature"]: r["csi"] for r in S.csi(a, b, names).collect()}
    assert got["same"] == 0 and got["empty"] == 0 and got["constant"] == 0 and got["moved"] > 0.2
    for c in names:
        assert got[c] == pytest.approx(brute_csi(train[c], prod[c]), abs=1e-9), c


def test_reliability(spark):
    one = C.reliability_table(pairs(spark, [0, 1, 0, 1], [0.3] * 4), "y", "s").collect()
    assert len(one) == 1 and one[0]["n"] == 4 and one[0]["observed_rate"] == 0.5
    rng = random.Random(2)
    rows = [(int(rng.random() < s), s) for s in (round(rng.random(), 2) for _ in range(500))]
    table = C.reliability_table(pairs(spark, *zip(*rows)), "y", "s").collect()
    assert sum(r["n"] for r in table) == 500


def test_calibration_curve_is_right_closed(spark):
    got = {r["bin"]: r["count"] for r in C.calibration_curve(pairs(spark, [0, 1, 1, 0], [0.0, 0.1, 0.11, 1.0]), "y", "s").collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def pool_adjacent(points):
    blocks = []
    for x, y, w in sorted(points):
        blocks.append([y * w, w, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, w2, xs = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][2] += xs
    return {x: s / w for s, w, xs in blocks for x in xs}


def test_isotonic_fit_is_the_pooled_solution(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < s * s), s) for s in (round(rng.random(), 2) for _ in range(800))]
    fitted = C.fit_isotonic(pairs(spark, *zip(*rows)), "y", "s")
    xs, ys = C.breakpoints(fitted)
    assert ys == sorted(ys)
    by_score = {}
    for y, s in rows:
        by_score.setdefault(s, []).append(y)
    want = pool_adjacent([(s, sum(v) / len(v), len(v)) for s, v in by_score.items()])
    for s, w in want.items():
        assert np.interp(s, xs, ys) == pytest.approx(w, abs=1e-9)


def test_isotonic_fit_of_the_registered_scores_is_pooled_by_brute_force(spark, data):
    from checks.catalog import QUERIES
    from checks.views import scored_lines

    by_score = {}
    for row in scored_lines(spark, data).collect():
        by_score.setdefault(row.p, []).append(row.label)
    blocks = []
    for x, labels in sorted(by_score.items()):
        blocks.append([sum(labels), len(labels), x, x])
        while len(blocks) > 1 and Fraction(*blocks[-2][:2]) >= Fraction(*blocks[-1][:2]):
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    want = sorted({(round(x, 8), round(s / n, 6)) for s, n, first, last in blocks for x in (first, last)})
    got = sorted((row.x, row.y) for row in QUERIES["m10_isotonic_fit_scores"](spark, data).collect())
    assert len(by_score) > 1000 and len(got) == len(want)
    assert [v for point in got for v in point] == pytest.approx([v for point in want for v in point], abs=1.5e-6)


def test_isotonic_fit_pools_equal_means(spark):
    # 8/11, 7/11 and 1/11 pool to 16/33, which a mean of rounded means misses
    rows = [(int(i < k), x) for x, (k, n) in enumerate([(8, 11), (7, 11), (1, 11), (16, 33)]) for i in range(n)]
    assert C.fit_isotonic(pairs(spark, *zip(*rows)), "y", "s").count() == 2


def test_describe_and_correlations_match_numpy(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), float(rng.randrange(5)), int(rng.random() < 0.4)) for _ in range(300)]
    df = frame(spark, rows, "a double, b double, y int")
    got = {r["feature"]: r for r in E.describe(df, ["a", "b"]).collect()}
    xs = np.array([r[0] for r in rows])
    assert got["a"]["std"] == pytest.approx(xs.std(ddof=1)) and got["a"]["p25"] == pytest.approx(np.quantile(xs, 0.25))
    corr = {(r["a"], r["b"]): r["corr"] for r in E.correlations(df, ["a", "b", "y"]).collect()}
    assert corr[("a", "b")] == pytest.approx(np.corrcoef(np.array(rows).T)[0, 1])
    assert E.top_correlations(df, ["a", "b"], "y", 1).count() == 1


def test_densities_integrate_to_one(spark):
    rng = random.Random(6)
    df = frame(spark, [(rng.gauss(0, 1), 1.0, i % 2) for i in range(400)], "a double, c double, y int")
    rows = S.class_densities(df, ["a", "c"], "y").collect()
    for label in (0, 1):
        xs = sorted(r["a"] for r in df.where(F.col("y") == label).select("a").collect())
        xs = [x for x in xs if x <= np.quantile(xs, 0.99)]
        width = (xs[-1] - xs[0]) / 50
        mine = [r for r in rows if r["feature"] == "a" and r["label"] == label]
        assert sum(r["density"] for r in mine) * width == pytest.approx(1.0)
        np.testing.assert_allclose([r["count"] for r in sorted(mine, key=lambda r: r["bin"])], [c for c in np.histogram(xs, 50)[0] if c])


def test_no_window_runs_over_all_rows(spark, data):
    """The running sum never gathers the rows in one partition."""
    rows = spark.read.parquet(f"{data}/lineitem.parquet").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_extendedprice") / 1e5).alias("s"))
    plan = R.score_ranks(rows, "y", "s")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "__range" in line.split("windowspecdefinition(")[1].split(",")[0]]
    assert windows, "the running window is partitioned by range"
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert linspace(0.0, 1.0, 3) == [0.0, 0.5, 1.0]


def test_correlations_of_pairs_with_missing_infinite_and_constant_values(spark):
    import pandas as pd

    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 5)) + 1e6
    x[:, 1] += x[:, 0]
    x[:, 2] = 0.1
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5, 4] = np.inf
    table = pd.DataFrame(x, columns=list("abcde"))
    got = {(r.a, r.b): (r.n, r.corr) for r in E.co_moments(spark.createDataFrame(table).repartition(6), list("abcde"), list("abcde")).collect()}
    assert len(got) == 25
    for a in "abcde":
        for b in "abcde":
            both = table[[a, b]].dropna() if a != b else table[[a]].dropna()
            n, corr = got[a, b]
            assert n == len(both) - (1 if "e" in (a, b) and np.isinf(both).any().any() else 0)
            if np.isinf(both).any().any():
                assert corr != corr
            elif "c" in (a, b):
                assert corr is None
            else:
                assert corr == pytest.approx(1.0 if a == b else both.corr().iloc[0, 1], abs=1e-9)
    none = E.co_moments(spark.createDataFrame(table).where("false"), ["a"], ["b"]).collect()
    assert all(r.corr is None and r.n == 0 for r in none)


@pytest.mark.parametrize("per_range", [3, 40, 50_000])
@pytest.mark.parametrize("shape", ["rising", "falling", "waves", "noise"])
def test_isotonic_rounds_end_in_the_pooled_solution(spark, per_range, shape):
    """Falls across the borders of ranges, whole tables that fall, and small ranges: always the fit of one pass."""
    rng = np.random.default_rng(3)
    n = 600
    base = {"rising": np.arange(n) / n, "falling": 1 - np.arange(n) / n, "waves": np.sin(np.arange(n) / 40) + np.arange(n) / n, "noise": rng.random(n)}[shape]
    y = base + 0.05 * rng.random(n)
    frame = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate(y)], "s double, y double").repartition(5)
    got = sorted(tuple(r) for r in C.fit_isotonic(frame, "y", "s", per_range).collect())
    first, last, total, weight = C.pooled((np.arange(n), np.arange(n)), y, np.ones(n))
    want = sorted({(float(x), t / w) for a, b, t, w in zip(first, last, total, weight) for x in (a, b)})
    assert [x for x, _ in got] == [x for x, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-9)


def test_a_million_steps_fit_and_apply_without_lists(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.col("id").cast("double").alias("s"), ((F.col("id") + F.when(F.col("id") % 1000 == 500, 2.5).otherwise(0)) / n).alias("y"))
    points = C.fit_isotonic(rows, "y", "s").cache()
    assert points.count() == n and points.select("y").distinct().count() == n - 1000  # every thousandth step holds two scores
    asked = spark.createDataFrame([(v,) for v in (None, float("nan"), -5.0, 0.0, 10.25, 501.0, 999_999.0, 2e6, 7.0, 7.0)], "p double")
    got = C.calibrated_by_table(asked, "p", points).collect()
    assert len(got) == 10
    value = {r.p: r.calibrated_pd for r in got if r.p is not None and r.p == r.p}
    step = (500 + 2.5 + 501) / 2 / n
    assert value == pytest.approx({-5.0: 0.0, 0.0: 0.0, 10.25: 10.25 / n, 501.0: step, 999_999.0: (n - 1) / n, 2e6: (n - 1) / n, 7.0: 7 / n})
    assert all(r.calibrated_pd is None for r in got if r.p is None or r.p != r.p)


def test_a_table_of_breakpoints_maps_as_the_lists_do(spark):
    rng = np.random.default_rng(5)
    xs, ys = np.sort(rng.random(50)).tolist(), np.sort(rng.random(50)).tolist()
    frame = spark.createDataFrame([(float(v),) for v in [*rng.random(300) * 1.4 - 0.2, *xs]], "p double")
    points = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    both = C.calibrated_by_table(frame, "p", points).withColumn("want", calibrated(F.col("p"), xs, ys)).collect()
    assert len(both) == 350 and [r.calibrated_pd for r in both] == pytest.approx([r.want for r in both], abs=1e-12)
    assert {r.calibrated_pd for r in C.calibrated_by_table(frame, "p", points.where("false")).collect()} == {None}


def test_quantiles_count_values_of_the_wanted_ranges_only(spark):
    rng = random.Random(8)
    rows = [(g, rng.random()) for g in "ab" for _ in range(2000)] + [("a", 0.5)] * 700 + [("b", None)]
    df = frame(spark, rows, "g string, v double")
    quantiles = order.exact_quantiles(df, "v", [0.0, 0.5, 1.0], ["g"], group_limit=2, n_ranges=40)
    got = {r["g"]: (r["quantiles"], r["n"]) for r in quantiles.collect()}
    for g in "ab":
        xs = [v for h, v in rows if h == g and v is not None]
        np.testing.assert_allclose(got[g][0], np.quantile(xs, [0.0, 0.5, 1.0]), rtol=0, atol=1e-12)
        assert got[g][1] == len(xs)
    plan = quantiles._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and order.RANGE in plan.split("LeftSemi")[0]
