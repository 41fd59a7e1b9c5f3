"""Distribution, ranking, calibration, fairness and descriptive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q, views as V
from riskframe.functions.numeric import round_away
from checks.registry import query, rounded
from riskframe.functions.binning import linspace
from riskframe.functions.tables import FEATURES, PROTECTED_ATTRIBUTES
from riskframe.operators import calibration as C, distributions as S, eda as E, fairness as X, ranking as R


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


EDGES = "SELECT b, b * 0.1::DOUBLE AS lo, CASE WHEN b = 9 THEN 1::DOUBLE ELSE (b + 1) * 0.1::DOUBLE END AS hi FROM range(10) t(b)"


def in_bin(v: str) -> str:
    return f"({v} >= lo AND (CASE WHEN b = 9 THEN {v} <= hi ELSE {v} < hi END))"


TWO_SIDED = f"""SELECT b, lo, hi,
  (SELECT count(*) FROM scored_lines WHERE l_linestatus = 'F' AND {in_bin('p')}) AS e,
  (SELECT count(*) FROM scored_lines WHERE l_linestatus <> 'F' AND {in_bin('p')}) AS a FROM edges"""


def sides(spark, d):
    rows = V.scored_lines(spark, d)
    return rows.where("l_linestatus = 'F'"), rows.where("l_linestatus <> 'F'")


# ---------------------------------------------------------------- distributions

@query("a1_histogram", Q.build(["scored_lines"], f"""
SELECT CAST(b AS INTEGER) AS bin, (SELECT count(*) FROM scored_lines WHERE {in_bin('q')}) AS count FROM edges""", {"edges": EDGES}))
def histogram(spark, d):
    return S.histogram(V.scored_lines(spark, d), "q", linspace(0.0, 1.0, 11))


LEVELS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@query("a2_exact_quantiles", Q.build(["scored_lines"], f"""
SELECT l_linestatus, q, {r('x')} AS value FROM ({Q.quantiles('scored_lines', 'p', LEVELS, 'l_linestatus')})"""))
def exact_quantiles(spark, d):
    found = S.exact_quantiles(V.scored_lines(spark, d), "p", LEVELS, ["l_linestatus"], group_limit=2)
    return rounded(found.select("l_linestatus", F.inline(F.arrays_zip(F.lit(LEVELS).alias("q"), F.col("quantiles").alias("value")))).toDF("l_linestatus", "q", "value"))


@query("a3_smoothed_shares", Q.build(["scored_lines"], f"""
SELECT CAST(b AS INTEGER) AS bin, n AS count, {r('(n + 1) / (sum(n) OVER () + 10)::DOUBLE')} AS share FROM (
  SELECT b, (SELECT count(*) FROM scored_lines WHERE {in_bin('q')}) AS n FROM edges)""", {"edges": EDGES}))
def shares(spark, d):
    return rounded(S.smoothed_shares(S.histogram(V.scored_lines(spark, d), "q", linspace(0.0, 1.0, 11))))


SHARES = "SELECT *, (e + 1) / (sum(e) OVER () + 10)::DOUBLE AS es, (a + 1) / (sum(a) OVER () + 10)::DOUBLE AS sa FROM two_sided"


@query("a4_psi", Q.build(["scored_lines"], f"SELECT {r('sum((sa - es) * ln(sa / es))')} AS psi FROM shares",
                         {"edges": EDGES, "two_sided": TWO_SIDED, "shares": SHARES}))
def psi(spark, d):
    return rounded(S.psi(*sides(spark, d), "p"))


CLIPPED = """SELECT *, greatest(e / (sum(e) OVER ())::DOUBLE, 1e-6) AS es, greatest(a / (sum(a) OVER ())::DOUBLE, 1e-6) AS sa FROM two_sided"""


@query("a5_psi_clipped_bins", Q.build(["scored_lines"], f"""
SELECT CAST(b AS INTEGER) AS bin, {r('es')} AS expected_share, {r('sa')} AS actual_share, {r('(sa - es) * ln(sa / es)', 8)} AS contribution FROM shares""",
                                      {"edges": EDGES, "two_sided": TWO_SIDED, "shares": CLIPPED}))
def psi_clipped(spark, d):
    counted = S.two_sided_histogram(*sides(spark, d), "p", linspace(0.0, 1.0, 11))
    bins = S.psi_bins(counted, "clip")
    return bins.select("bin", round_away("expected_share", 6).alias("expected_share"), round_away("actual_share", 6).alias("actual_share"),
                       round_away("contribution", 8).alias("contribution"))


SHIFTED = ["annual_inc", "dti", "fico_score", "loan_amnt", "revol_util", "term", "credit_history_months", "high_utilization"]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, split = 'train' AS e FROM gold WHERE split IN ('train', 'test')" for c in SHIFTED)
CSI_PARTS = {
    "long": LONG,
    "marks": f"SELECT feature, q, x FROM ({Q.quantiles('long', 'v', [i / 10 for i in range(11)], 'feature')})",
    "cuts": "SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY feature) - 1 AS k FROM (SELECT DISTINCT feature, x FROM marks)",
    "bins": """SELECT a.feature, a.i, a.x AS lo, b.x AS hi, a.k, a.i = a.k - 1 AS last FROM cuts a JOIN cuts b ON a.feature = b.feature AND b.i = a.i + 1""",
    "filled_bins": """SELECT b.feature, b.i, b.k,
  count(*) FILTER (WHERE l.e) AS ec, count(*) FILTER (WHERE NOT l.e) AS ac FROM bins b
  LEFT JOIN long l ON l.feature = b.feature AND l.v >= b.lo AND (CASE WHEN b.last THEN l.v <= b.hi ELSE l.v < b.hi END) GROUP BY ALL""",
    "shares": """SELECT *, (ec + 1) / (sum(ec) OVER (PARTITION BY feature) + k)::DOUBLE AS es, (ac + 1) / (sum(ac) OVER (PARTITION BY feature) + k)::DOUBLE AS sa FROM filled_bins""",
    "csi": "SELECT feature, sum((sa - es) * ln(sa / es)) AS csi FROM shares GROUP BY feature",
}


def csi_of(spark, d):
    rows = V.gold(spark, d)
    return S.csi(rows.where("split = 'train'"), rows.where("split = 'test'"), SHIFTED)


@query("a6_csi", Q.build(["gold"], f"SELECT feature, {r('csi')} AS csi FROM csi", CSI_PARTS))
def csi(spark, d):
    return rounded(csi_of(spark, d))


@query("a7_drifted_features", Q.build(["gold"], "SELECT feature, round(csi, 4) AS csi FROM csi WHERE round(csi, 4) > 0.001", CSI_PARTS))
def drifted(spark, d):
    # the synthetic splits hardly differ, so the threshold is set low enough to act
    from riskframe.contract import Contract

    return S.drifted_features(csi_of(spark, d), Contract(csi_threshold=0.001))


# ---------------------------------------------------------------- ranking

@query("a8_roc_auc", Q.build(["scored_lines"], f"SELECT {r('auc', 9)} AS auc FROM ({Q.auc('scored_lines', 'label', 'p')})"))
def roc_auc(spark, d):
    return rounded(R.roc_auc(V.scored_lines(spark, d), "label", "p"), 9)


@query("a8_roc_auc_ties", Q.build(["scored_lines"], f"SELECT {r('auc', 9)} AS auc FROM ({Q.auc('scored_lines', 'label', 'q')})"))
def roc_auc_ties(spark, d):
    return rounded(R.roc_auc(V.scored_lines(spark, d), "label", "q"), 9)


@query("a9_ks", Q.build(["scored_lines"], f"SELECT {r('ks', 9)} AS ks FROM ({Q.auc('scored_lines', 'label', 'p')})"))
def ks(spark, d):
    return rounded(R.ks_statistic(V.scored_lines(spark, d), "label", "p"), 9)


@query("a11_metrics_per_split", Q.build(["scored_gold"], f"""
SELECT split, n, {r('auc')} AS auc, {r('ks')} AS ks, {r('2 * auc - 1')} AS gini FROM ({Q.auc('scored_gold', '"default"', 'score', 'split')})"""))
def metrics(spark, d):
    return rounded(R.ranking_metrics(V.scored_gold(spark, d), "default", "score", ["split"], group_limit=3))


def decile_parts(source: str, label: str, score: str) -> dict[str, str]:
    return {
        "marks": f"SELECT DISTINCT x FROM ({Q.quantiles(source, score, [i / 10 for i in range(11)])})",
        "cuts": "SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM marks",
        "bins": "SELECT a.i, a.x AS lo, b.x AS hi FROM cuts a JOIN cuts b ON b.i = a.i + 1",
        "deciles": f"""SELECT row_number() OVER (ORDER BY b.i) - 1 AS decile, count(*) AS n, avg({label}) AS rate, avg({score}) AS mean FROM bins b
  JOIN {source} s ON s.{score} <= b.hi AND (s.{score} > b.lo OR (b.i = 0 AND s.{score} = b.lo)) GROUP BY b.i""",
        "broken": "SELECT count(*) AS rank_order_breaks FROM (SELECT rate < lag(rate) OVER (ORDER BY decile) AS worse FROM deciles) WHERE worse",
    }


@query("a12_score_deciles", Q.build(["scored_lines"], f"""
SELECT CAST(decile AS INTEGER) AS decile, n AS count, {r('rate')} AS default_rate, {r('mean')} AS avg_score FROM deciles""",
                                    decile_parts("scored_lines", "label", "p")))
def deciles(spark, d):
    return rounded(R.score_deciles(V.scored_lines(spark, d), "label", "p"))


@query("a12_score_deciles_ties", Q.build(["scored_gold"], f"""
SELECT CAST(decile AS INTEGER) AS decile, n AS count, {r('rate')} AS default_rate, {r('mean')} AS avg_score FROM deciles""",
                                         decile_parts("scored_gold", '"default"', "score")))
def deciles_ties(spark, d):
    return rounded(R.score_deciles(V.scored_gold(spark, d), "default", "score"))


@query("a13_rank_order_breaks", Q.build(["scored_lines"], "SELECT rank_order_breaks FROM broken", decile_parts("scored_lines", "label", "p")))
def breaks(spark, d):
    return R.rank_order_breaks(R.score_deciles(V.scored_lines(spark, d), "label", "p"))


GAINS = {
    "ranked": "SELECT id, score, \"default\" AS y, row_number() OVER (ORDER BY score, id) AS rk, count(*) OVER () AS n FROM scored_gold",
    "placed": "SELECT *, CASE WHEN rk = 1 THEN 1 ELSE CAST(((rk - 1) * 10 + (n - 1) - 1) // (n - 1) AS INTEGER) END AS decile FROM ranked",
    "gains": """SELECT decile, count(*) AS cnt, CAST(sum(y) AS BIGINT) AS n_defaults, avg(y) AS default_rate, avg(score) AS avg_score,
  min(score) AS min_score, max(score) AS max_score FROM placed GROUP BY decile""",
}


def gains_of(spark, d):
    return R.gains_table(V.scored_gold(spark, d), "default", "score", "id")


@query("a14_gains_table", Q.build(["scored_gold"], f"""
SELECT decile, cnt AS count, n_defaults, {r('default_rate')} AS default_rate, {r('avg_score')} AS avg_score, {r('min_score')} AS min_score,
  {r('max_score')} AS max_score, CAST(sum(n_defaults) OVER (ORDER BY decile) AS BIGINT) AS cumulative_defaults,
  {r('sum(n_defaults) OVER (ORDER BY decile) / (sum(n_defaults) OVER ())::DOUBLE')} AS capture_rate FROM gains""", GAINS))
def gains(spark, d):
    return rounded(gains_of(spark, d))


@query("a14_top_capture", Q.build(["scored_gold"], f"""
SELECT {r('sum(n_defaults) FILTER (WHERE decile > 7) / sum(n_defaults)::DOUBLE')} AS top_capture FROM gains""", GAINS))
def top_capture(spark, d):
    return rounded(R.top_capture(gains_of(spark, d)))


CURVE = {"curve": """SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (SELECT p AS s, sum(label) AS pos, sum(1 - label) AS neg FROM scored_lines GROUP BY p)"""}


@query("a15_roc_points", Q.build(["scored_lines"], f"""
SELECT {r('s', 8)} AS threshold, {r('fp / n::DOUBLE')} AS fpr, {r('tp / p::DOUBLE')} AS tpr FROM curve UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0""", CURVE))
def roc_points(spark, d):
    points = R.roc_points(V.scored_lines(spark, d), "label", "p")
    return points.select(round_away("threshold", 8).alias("threshold"), round_away("fpr", 6).alias("fpr"), round_away("tpr", 6).alias("tpr"))


@query("a16_precision_recall_points", Q.build(["scored_lines"], f"""
SELECT {r('s', 8)} AS threshold, {r('tp / (tp + fp)::DOUBLE')} AS precision, {r('tp / p::DOUBLE')} AS recall FROM curve UNION ALL SELECT NULL, 1, 0""", CURVE))
def pr_points(spark, d):
    points = R.precision_recall_points(V.scored_lines(spark, d), "label", "p")
    return points.select(round_away("threshold", 8).alias("threshold"), round_away("precision", 6).alias("precision"), round_away("recall", 6).alias("recall"))


# ---------------------------------------------------------------- calibration

@query("a17_calibration_curve", Q.build(["scored_lines"], f"""
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS count, {r('avg(q)')} AS mean_predicted, {r('avg(label)')} AS observed_rate FROM (
  SELECT *, ({' + '.join(f'CAST({i} * 0.1::DOUBLE < q AS INTEGER)' for i in range(1, 10))}) AS bin FROM scored_lines) GROUP BY bin"""))
def calibration_curve(spark, d):
    return rounded(C.calibration_curve(V.scored_lines(spark, d), "label", "q"))


@query("a18_reliability_table", Q.build(["scored_lines"], f"""
SELECT CAST(b.i AS INTEGER) AS bin, count(*) AS n, {r('avg(p)')} AS mean_predicted, {r('avg(label)')} AS observed_rate
FROM bins b JOIN scored_lines s ON s.p >= b.lo AND (CASE WHEN b.i = (SELECT max(i) FROM bins) THEN s.p <= b.hi ELSE s.p < b.hi END) GROUP BY b.i""", {
    k: v for k, v in decile_parts("scored_lines", "label", "p").items() if k in ("marks", "cuts", "bins")}))
def reliability(spark, d):
    return rounded(C.reliability_table(V.scored_lines(spark, d), "label", "p"))


@query("a19_brier_scores", Q.build(["scored_gold"], f"""
SELECT 'score' AS series, {r('avg((score - "default") ** 2)')} AS brier FROM scored_gold
UNION ALL SELECT 'pd', {r('avg((pd - "default") ** 2)')} FROM scored_gold"""))
def brier(spark, d):
    return rounded(C.brier_scores(V.scored_gold(spark, d), "default", ["score", "pd"]))


# ---------------------------------------------------------------- fairness

NAMES = "VALUES " + ", ".join(
    f"('{a}', {code}, '{label}', {'true' if code == top else 'false'})"
    for a, (labels, top, _) in PROTECTED_ATTRIBUTES.items() for code, label in labels.items())


def fairness_parts(score: str = "pd", tag: str = "") -> dict[str, str]:
    long = " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, CAST({a} AS INTEGER) AS code, \"default\" AS y, {score} AS s FROM scored_gold WHERE split = 'test'" for a in PROTECTED_ATTRIBUTES)
    return {
        f"names{tag}": f"SELECT * FROM ({NAMES}) t(attribute, code, grp, privileged)",
        f"protected{tag}": long,
        f"aucs{tag}": Q.auc(f"protected{tag}", "y", "s", "attribute, code"),
        f"groups{tag}": f"""SELECT l.attribute, l.code, n.grp, n.privileged, count(*) AS cnt, round(avg(y), 4) AS default_rate,
  round(avg(CAST(s < 0.15 AS INTEGER)), 4) AS approval_rate, round(avg(CAST(s >= 0.30 AS INTEGER)), 4) AS decline_rate,
  round(avg(s), 4) AS mean_score, coalesce(avg(CASE WHEN y = 0 THEN CAST(s < 0.15 AS INTEGER) END), 0) AS good_rate
  FROM protected{tag} l JOIN names{tag} n USING (attribute, code) GROUP BY ALL HAVING count(*) >= 10""",
        f"against{tag}": f"""SELECT g.*, t.approval_rate AS top_rate, t.good_rate AS top_good FROM groups{tag} g
  LEFT JOIN groups{tag} t ON t.attribute = g.attribute AND t.privileged""",
        f"summary{tag}": f"""SELECT attribute, grp AS "group", privileged, CASE WHEN privileged THEN 1 ELSE round(approval_rate / top_rate, 4) END::DOUBLE AS dir,
  round(good_rate - top_good, 4) AS eod, round(approval_rate - top_rate, 4) AS spd, approval_rate, default_rate,
  NOT privileged AND approval_rate / top_rate < 0.8 AS violation FROM against{tag} WHERE top_rate > 0""",
    }


FAIR = fairness_parts()


def groups_of(spark, d, score="pd"):
    return X.group_rates(V.scored_gold(spark, d).where("split = 'test'"), "default", score)


@query("a20_group_metrics", Q.build(["scored_gold"], f"""
SELECT g.attribute, g.code, g.grp AS "group", g.privileged, cnt AS count, default_rate, approval_rate, decline_rate, mean_score,
  {r('good_rate')} AS approve_rate_good, round(a.auc, 4) AS auc FROM groups g LEFT JOIN aucs a USING (attribute, code)""", FAIR))
def group_metrics(spark, d):
    return rounded(X.group_metrics(V.scored_gold(spark, d).where("split = 'test'"), "default", "pd"))


@query("a21_disparate_impact", Q.build(["scored_gold"], 'SELECT attribute, "group", privileged, dir, violation FROM summary', FAIR))
def impact(spark, d):
    return X.disparate_impact(groups_of(spark, d))


@query("a22_equal_opportunity", Q.build(["scored_gold"], 'SELECT attribute, grp AS "group", round(good_rate - coalesce(top_good, 0), 4) AS eod FROM against', FAIR))
def opportunity(spark, d):
    return X.equal_opportunity(groups_of(spark, d))


@query("a23_statistical_parity", Q.build(["scored_gold"], 'SELECT attribute, grp AS "group", round(approval_rate - coalesce(top_rate, 0), 4) AS spd FROM against', FAIR))
def parity(spark, d):
    return X.statistical_parity(groups_of(spark, d))


@query("a24_fairness_report", Q.build(["scored_gold"], "SELECT * FROM summary", FAIR))
def report(spark, d):
    return X.fairness_report(V.scored_gold(spark, d).where("split = 'test'"), "default", "pd")


@query("a25_worst_impact", Q.build(["scored_gold"], "SELECT least(1.0::DOUBLE, min(dir)) AS worst_dir FROM summary", FAIR))
def worst(spark, d):
    return X.worst_impact(X.fairness_summary(groups_of(spark, d)))


@query("a33_overall_rates", Q.build(["scored_gold"], """
SELECT count(*) AS n_observations, round(avg(CAST(pd < 0.15 AS INTEGER)), 4) AS approval_rate, round(avg("default"), 4) AS default_rate FROM scored_gold"""))
def overall(spark, d):
    return X.overall_rates(V.scored_gold(spark, d), "default", "pd")


# ---------------------------------------------------------------- descriptive

@query("a26_rate_by_grade", Q.build(["gold"], f'SELECT grade_numeric, {r("avg(\"default\")")} AS default_rate, count(*) AS count FROM gold GROUP BY 1'))
def by_grade(spark, d):
    return rounded(E.rate_by(V.gold(spark, d), "grade_numeric", "default"))


@query("a27_rate_by_fico_band", Q.build(["gold"], f"""
SELECT band, {r('avg("default")')} AS default_rate, count(*) AS count FROM (
  SELECT "default", CASE WHEN fico_score > 600 AND fico_score <= 850 THEN
    CASE WHEN fico_score <= 650 THEN '600-650' WHEN fico_score <= 700 THEN '650-700' WHEN fico_score <= 750 THEN '700-750'
         WHEN fico_score <= 800 THEN '750-800' ELSE '800-850' END END AS band FROM gold) WHERE band IS NOT NULL GROUP BY band"""))
def by_band(spark, d):
    return rounded(E.rate_by_band(V.gold(spark, d), "fico_score", "default"))


@query("a28_split_drift", Q.build(["gold"], f"""
SELECT split, count(*) AS rows, CAST(sum("default") AS BIGINT) AS defaults, CAST(sum(1 - "default") AS BIGINT) AS non_defaults,
  {r('avg("default")')} AS default_rate FROM gold GROUP BY split"""))
def split_drift(spark, d):
    return rounded(E.split_drift(V.gold(spark, d)))


DESCRIBED = ["annual_inc", "dti", "fico_score", "loan_amnt", "revol_util", "credit_history_months"]


@query("a29_describe", Q.build(["gold"], f"""
SELECT s.feature, s.n AS count, {r('s.mean')} AS mean, {r('s.std')} AS std, {r('s.mn')} AS min, {r('p.p25')} AS p25, {r('p.p50')} AS p50,
  {r('p.p75')} AS p75, {r('s.mx')} AS max
FROM (SELECT feature, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS mn, max(v) AS mx FROM flat GROUP BY feature) s
JOIN (SELECT feature, max(x) FILTER (WHERE q = 0.25) AS p25, max(x) FILTER (WHERE q = 0.5) AS p50, max(x) FILTER (WHERE q = 0.75) AS p75
  FROM ({Q.quantiles('flat', 'v', [0.25, 0.5, 0.75], 'feature')}) GROUP BY feature) p USING (feature)""", {
    "flat": " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM gold" for c in DESCRIBED)}))
def describe(spark, d):
    return rounded(E.describe(V.gold(spark, d), DESCRIBED))


CORRELATED = ["annual_inc", "dti", "fico_score", "loan_amnt", "installment", "default"]


@query("a30_correlations", Q.build(["gold"], " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, {r(f'corr("{a}", "{b}")')} AS corr FROM gold"""
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:])))
def correlations(spark, d):
    return rounded(E.correlations(V.gold(spark, d), CORRELATED))


ALL_CORRELATED = [*FEATURES, "default"]


@query("a30_correlation_matrix", Q.build(["gold"], " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, {r(f'corr("{a}", "{b}")', 5)} AS corr FROM gold"""
    for i, a in enumerate(ALL_CORRELATED) for b in ALL_CORRELATED[i + 1:])))
def correlation_matrix(spark, d):
    """All features and the target."""
    return rounded(E.correlations(V.gold(spark, d), ALL_CORRELATED), 5)


SMALLER = ["annual_inc", "dti", "fico_score", "loan_amnt", "installment", "revol_bal", "int_rate", "open_acc", "total_acc", "revol_util",
           "credit_history_months", "grade_numeric", "sub_grade_numeric", "log_annual_inc", "loan_to_income", "dti_x_income", "home_ownership", "purpose"]


@query("a30_top_correlations", Q.build(["gold"], "SELECT feature, round(corr, 6) AS corr FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, corr("{c}", "default") AS corr FROM gold""" for c in SMALLER) + ") ORDER BY abs(corr) DESC, feature LIMIT 15"))
def top_correlations(spark, d):
    return rounded(E.top_correlations(V.gold(spark, d), SMALLER, "default"))


DENSITY = ["fico_score", "dti", "loan_amnt", "annual_inc"]


@query("a31_class_densities", Q.build(["gold"], f"""
SELECT k.feature, k.label, CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS count,
  {r('count(*) / (max(total) * max((hi - lo) / 50))::DOUBLE', 9)} AS density
FROM kept k JOIN (SELECT feature, label, min(v) AS lo, max(v) AS hi, count(*) AS total FROM kept GROUP BY ALL) e USING (feature, label) GROUP BY ALL""", {
    "flat": " UNION ALL ".join(f"SELECT '{c}' AS feature, \"default\" AS label, {c} AS v FROM gold WHERE split = 'train'" for c in DENSITY),
    "tops": Q.quantiles("flat", "v", [0.99], "feature, label"),
    "kept": "SELECT f.* FROM flat f JOIN tops t USING (feature, label) WHERE v <= x"}))
def densities(spark, d):
    rows = S.class_densities(V.gold(spark, d).where("split = 'train'"), DENSITY, "default")
    return rows.select("feature", "label", "bin", "count", round_away("density", 9).alias("density"))


@query("a32_both_classes", Q.build(["gold"], 'SELECT grade_numeric, min("default") <> max("default") AS both_classes FROM gold GROUP BY 1'))
def both_classes(spark, d):
    return R.has_both_classes(V.gold(spark, d), "default", ["grade_numeric"])
