"""Tree, scoring, training, comparison and verdict queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import sql as Q, views as V
from checks.q_logs import ADMITTED, LOOKED
from checks.q_measure import FAIR, decile_parts, fairness_parts
from riskframe.functions.numeric import round_away
from checks.registry import query, rounded
from riskframe.functions.scorecard import calibrated, decision, points
from riskframe.functions.tables import FEATURES, REASONS
from riskframe.operators import calibration as C, distributions as S, fairness as X, training as M, trees as T, verdicts as W
from riskframe.operators.history import logged_outcomes, logged_scores
from riskframe.operators.ranking import ranking_metrics
from riskframe.operators.silver import silver_rejected
from riskframe.plans import scoring as P
from riskframe.plans.retrain import retrain as train_challenger
from riskframe.session import scratch_path
from riskframe.sources.layers import write_once

USED = ["dti", "fico_score", "loan_to_income"]


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


# ---------------------------------------------------------------- trees

@query("m4_invalid_nodes", f"""
WITH heap AS (SELECT o_custkey AS tree_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS node_id,
  count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey, o_orderstatus FROM orders)
SELECT CAST(tree_id AS INTEGER) AS tree_id, CAST(node_id AS INTEGER) AS node_id,
  CASE WHEN 2 * node_id + 2 >= n THEN 'child' ELSE 'feature' END AS problem
FROM heap WHERE NOT (o_orderstatus = 'F' AND 2 * node_id + 2 >= n) AND (2 * node_id + 2 >= n OR o_orderkey % 35 >= {len(FEATURES)})""")
def invalid_nodes(spark, d):
    return T.invalid_nodes(V.heap_nodes(spark, d), list(FEATURES))


@query("m5_batch_score", Q.build(["model_input"], f"""
SELECT id, {r(Q.RAW3, 9)} AS raw_score, {r(Q.probability(Q.RAW3), 9)} AS score FROM model_input"""))
def batch_score(spark, d):
    model = V.ensemble(spark)
    rows = T.with_probability(T.with_raw_score(V.model_input(spark, d), model), model)
    return rounded(rows.select("id", "raw_score", "score"), 9)


@query("m5_batch_score_vectorised", Q.build(["model_input"], f"""
SELECT id, {r(Q.RAW3, 9)} AS raw_score FROM model_input"""))
def batch_score_vectorised(spark, d):
    rows = V.model_input(spark, d)
    return rounded(rows.select("id", T.raw_score_vectorised(spark, V.ensemble(spark)).alias("raw_score")), 9)


# counts of rows at every node of the three trees
COVERS = {"covers": """SELECT count(*)::DOUBLE AS n,
  count(*) FILTER (WHERE fico_score <= 700)::DOUBLE AS a1,
  count(*) FILTER (WHERE fico_score <= 700 AND (dti IS NULL OR dti <= 40))::DOUBLE AS a2,
  count(*) FILTER (WHERE loan_to_income <= 0.35)::DOUBLE AS b1,
  count(*) FILTER (WHERE loan_to_income > 0.35 AND fico_score <= 680)::DOUBLE AS b3,
  count(*) FILTER (WHERE dti <= 60)::DOUBLE AS c1,
  count(*) FILTER (WHERE dti <= 20)::DOUBLE AS c2,
  count(*) FILTER (WHERE (dti IS NULL OR dti > 60) AND loan_to_income <= 0.2)::DOUBLE AS c5
FROM model_input"""}
EXPECTED = f"""({V.BASELINE}::DOUBLE
  + (a2 * -0.2 + (a1 - a2) * 0.6 + (n - a1) * -0.9) / n
  + (b1 * -0.5 + b3 * 0.8 + (n - b1 - b3) * 0.1) / n
  + (c2 * -0.4 + (c1 - c2) * 0.05 + c5 * 0.3 + (n - c1 - c5) * 0.7) / n)"""


def covered(spark, d):
    """The node table with covers counted on the model inputs."""
    return T.node_covers(V.model_input(spark, d), V.tree_nodes(spark))


@query("m6_expected_value", Q.build(["model_input"], f"SELECT {r(EXPECTED, 9)} AS expected_value FROM covers", COVERS))
def expected_value(spark, d):
    return rounded(T.expected_value(covered(spark, d), V.BASELINE), 9)


def one_feature(v: float, o: str, z: str) -> str:
    return f"{v} * (({o}) - ({z}))"


def first_of_two(v: float, o1: str, z1: str, o2: str, z2: str) -> str:
    return f"{v} * (({o1}) - ({z1})) * (({o2}) + ({z2})) / 2"


F7, D40 = "CAST(fico_score <= 700 AS INTEGER)", "CAST(dti IS NULL OR dti <= 40 AS INTEGER)"
L35, F68 = "CAST(loan_to_income <= 0.35 AS INTEGER)", "CAST(fico_score <= 680 AS INTEGER)"
D60, D20 = "CAST(coalesce(dti <= 60, false) AS INTEGER)", "CAST(coalesce(dti <= 20, false) AS INTEGER)"
L20 = "CAST(loan_to_income <= 0.2 AS INTEGER)"
NOT = "(1 - {0})".format
# leaves as (value, {feature: (agreement, share)})
LEAVES = [
    (-0.2, {"fico_score": (F7, "a1 / n"), "dti": (D40, "a2 / a1")}),
    (0.6, {"fico_score": (F7, "a1 / n"), "dti": (NOT(D40), "(a1 - a2) / a1")}),
    (-0.9, {"fico_score": (NOT(F7), "(n - a1) / n")}),
    (-0.5, {"loan_to_income": (L35, "b1 / n")}),
    (0.8, {"loan_to_income": (NOT(L35), "(n - b1) / n"), "fico_score": (F68, "b3 / (n - b1)")}),
    (0.1, {"loan_to_income": (NOT(L35), "(n - b1) / n"), "fico_score": (NOT(F68), "(n - b1 - b3) / (n - b1)")}),
    (-0.4, {"dti": (D20, "c2 / n")}),
    (0.05, {"dti": (f"{D60} * {NOT(D20)}", "(c1 - c2) / n")}),
    (0.3, {"dti": (NOT(D60), "(n - c1) / n"), "loan_to_income": (L20, "c5 / (n - c1)")}),
    (0.7, {"dti": (NOT(D60), "(n - c1) / n"), "loan_to_income": (NOT(L20), "(n - c1 - c5) / (n - c1)")}),
]


def contribution(feature: str) -> str:
    terms = []
    for v, path in LEAVES:
        if feature in path:
            rest = [p for f, p in path.items() if f != feature]
            terms.append(one_feature(v, *path[feature]) if not rest else first_of_two(v, *path[feature], *rest[0]))
    return " + ".join(terms)


PHI = {**COVERS, "phi": " UNION ALL ".join(
    f"SELECT id, '{f}' AS feature, {contribution(f)} AS contribution, {f} AS value FROM model_input, covers" for f in USED)}


def attributed(spark, d):
    model = T.load_ensemble(covered(spark, d), V.BASELINE)
    return T.with_attributions(V.model_input(spark, d), model)


@query("m7_attributions", Q.build(["model_input"], f"SELECT id, feature, {r('contribution', 8)} AS contribution, {r('value', 8)} AS value FROM phi", PHI))
def attributions(spark, d):
    return rounded(attributed(spark, d).select("id", F.inline("contributions")), 8)


@query("m7_attributions_vectorised", Q.build(["model_input"], f"SELECT id, feature, {r('contribution', 8)} AS contribution FROM phi", PHI))
def attributions_vectorised(spark, d):
    model = T.load_ensemble(covered(spark, d), V.BASELINE)
    rows = V.model_input(spark, d).select("id", T.attributions_vectorised(spark, model).alias("phi"))
    names = F.lit(model.features)
    return rounded(rows.select("id", F.inline(F.arrays_zip(names.alias("feature"), F.col("phi").alias("contribution")))).toDF("id", "feature", "contribution"), 8)


@query("m8_global_importance", Q.build(["model_input"], f"""
SELECT feature, {r('avg(abs(contribution))', 8)} AS importance, CAST(row_number() OVER (ORDER BY avg(abs(contribution)) DESC, feature) AS INTEGER) AS rank FROM phi GROUP BY feature""", PHI))
def importance(spark, d):
    return rounded(T.global_importance(attributed(spark, d)), 8)


# contributions with shared reason codes, straight from the features
PUSHES = {
    "dti": "(dti - 30) / 100", "dti_x_income": "(dti_x_income - 2000) / 10000", "loan_amnt": "(loan_amnt - 20000) / 50000",
    "term": "(term - 40) / 100", "fico_score": "(700 - fico_score) / 200", "annual_inc": "(60000 - annual_inc) / 100000",
    "revol_util": "(revol_util - 50) / 100", "high_utilization": "high_utilization * 0.2",
}
REASON_ROWS = "VALUES " + ", ".join(f"('{f}', {REASONS[f][0]}, '{REASONS[f][1]}', '{REASONS[f][2]}')" for f in PUSHES)
T5 = {
    "reasons": f"SELECT * FROM ({REASON_ROWS}) t(feature, code, reason, display)",
    "pushes": " UNION ALL ".join(
        f"SELECT id, '{f}' AS feature, {e.replace('0.2', '0.2::DOUBLE')} AS c, {f} AS v FROM scored_gold WHERE pd >= 0.15" for f, e in PUSHES.items()),
    "best": """SELECT p.*, code, reason, display FROM pushes p JOIN reasons USING (feature) WHERE c > 0
  QUALIFY row_number() OVER (PARTITION BY id, code ORDER BY c DESC, feature) = 1""",
    "kept": "SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, feature) AS position FROM best QUALIFY position <= 4",
}


@query("t5_adverse_actions", Q.build(["scored_gold"], """
SELECT id, CAST(position AS INTEGER) AS position, code, reason, display AS feature_name, round(c, 5) AS shap_value, round(v, 4) AS feature_value FROM kept""", T5))
def adverse_actions(spark, d):
    parts = [
        F.struct(F.lit(f).alias("feature"), F.expr(e.replace("0.2", "0.2D")).alias("contribution"), F.col(f).alias("value"))
        for f, e in PUSHES.items()
    ]
    rows = V.scored_gold(spark, d).withColumn("contributions", F.array(*parts)).withColumn("decision", decision(F.col("pd")))
    return T.with_reasons(rows).select("id", F.posexplode("adverse_actions").alias("p", "a")).select(
        "id", (F.col("p") + 1).alias("position"), "a.code", "a.reason", "a.feature_name", "a.shap_value", "a.feature_value")


# ---------------------------------------------------------------- calibration and decisions

@query("m11_apply_calibrator", Q.build(["scored_lines"], f"SELECT {r('q', 2)} AS q, {r('p', 8)} AS p, {r(Q.apply_calibrator('p'), 10)} AS pd FROM scored_lines"))
def apply_calibrator(spark, d):
    rows = V.scored_lines(spark, d).select(round_away("q", 2).alias("q"), "p", calibrated(F.col("p"), *V.CALIBRATOR).alias("pd"))
    return rows.select("q", round_away("p", 8).alias("p"), round_away("pd", 10).alias("pd"))


@query("m12_scorecard_points", Q.build(["scored_gold"], f"SELECT id, {Q.points('pd')} AS points FROM scored_gold"))
def scorecard(spark, d):
    return V.scored_gold(spark, d).select("id", points(F.col("pd")).alias("points"))


@query("m13_decisions", Q.build(["scored_gold"], f"SELECT id, {Q.decision('pd')} AS calibrated, {Q.decision('score')} AS raw FROM scored_gold"))
def decisions(spark, d):
    return V.scored_gold(spark, d).select("id", decision(F.col("pd")).alias("calibrated"), decision(F.col("score")).alias("raw"))


LOOKED_RAW = f"{Q.RAW3}"
M14_PARTS = {
    "looked": LOOKED, "admitted": ADMITTED,
    "failed": """SELECT *, CASE WHEN NOT regexp_full_match(applicant_id, '[A-Za-z0-9_-]+')
  THEN 'applicant_id may contain only letters, digits, ''_'' and ''-''' WHEN verdict <> 'ok' THEN verdict END AS error FROM admitted""",
    "scored": f"SELECT *, {Q.probability(Q.RAW3)} AS s FROM failed",
    "graded": f"SELECT *, {Q.apply_calibrator('s')} AS pd FROM scored",
}


@query("m14_score_requests", Q.build(["requests", "feature_store"], f"""
SELECT request_id, applicant_id, error, CASE WHEN error IS NULL THEN round(s, 5) END AS score, CASE WHEN error IS NULL THEN round(pd, 5) END AS calibrated_pd,
  CASE WHEN error IS NULL THEN {Q.points('pd')} END AS scaled_score, CASE WHEN error IS NULL THEN {Q.decision('pd')} END AS decision,
  CASE WHEN error IS NULL THEN fico_score END AS fico_score, CASE WHEN error IS NULL THEN grade END AS grade FROM graded""", M14_PARTS))
def score_all(spark, d):
    """Both tables read back after one write; the second write of the same batch changes nothing."""
    model = T.load_ensemble(T.node_covers(V.gold(spark, d), V.tree_nodes(spark)), V.BASELINE)
    done = P.score_requests(V.requests(spark, d), V.feature_store(spark, d), model, V.CALIBRATOR, V.now(), V.MODEL_VERSION, 1)
    table = P.scored_table(spark, scratch_path(spark, "scored"))
    P.write_scored(table, done, batch=0)
    P.write_scored(table, done, batch=0)
    both = P.written_results(table).unionByName(P.written_errors(table), allowMissingColumns=True)
    return both.select("request_id", "applicant_id", "error", "score", "calibrated_pd", "scaled_score", "decision", "fico_score", "grade")


# ---------------------------------------------------------------- training

MODEL_FEATURES = list(FEATURES)
_FITS: dict[tuple[str, str], M.Boosted] = {}


def carved(spark, d):
    rows = V.gold(spark, d)
    return M.early_stopping_rows(rows.where("split = 'train'"), rows.where("split = 'val'"), "default", "id")


def labelled(spark, d):
    """Gold rows with a target that follows the features, so that a model has something to learn."""
    z = (F.col("fico_score") - 740) / -40 + (F.col("dti") - 45) / 30 + F.col("loan_to_income")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    return V.gold(spark, d).withColumn("default", (noise < 1 / (1 + F.exp(-z + 1))).cast("int"))


@query("m1_carve_out", Q.build(["gold"], """
SELECT "default", held_out, CASE WHEN held_out THEN held ELSE n - held END AS n FROM (
  SELECT "default", count(*) AS n, round(count(*) * (SELECT avg(CAST(split = 'val' AS INTEGER)) FROM gold WHERE split <> 'test'))::BIGINT AS held
  FROM gold WHERE split <> 'test' GROUP BY "default") CROSS JOIN (VALUES (true), (false)) t(held_out)
WHERE CASE WHEN held_out THEN held ELSE n - held END > 0"""))
def carve_out(spark, d):
    """Held-out rows per label; repeatability is tested in pytest."""
    return carved(spark, d).groupBy("default", "held_out").agg(F.count(F.lit(1)).alias("n"))


def trained(spark, d) -> M.Boosted:
    """The champion's parameters on all features. Fitted once per application: the first of the queries on it takes the time."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITS:
        rows = labelled(spark, d)
        both = M.early_stopping_rows(rows.where("split = 'train'"), rows.where("split = 'val'"), "default", "id")
        _FITS[key] = M.train_boosted(both, MODEL_FEATURES, "default", parameters=M.CHAMPION)
    return _FITS[key]


@query("m2_boosted_trees")
def boosted_trees(spark, d):
    """Ranking power per split of a freshly trained model, and its number of trees."""
    fitted, path = trained(spark, d), scratch_path(spark, "boosted-scores")
    # ranking reads the scores several times
    write_once(T.with_probability(labelled(spark, d), fitted.ensemble(spark), "score").select("split", "default", "score"), path)
    scored = spark.read.parquet(path)
    return ranking_metrics(scored, "default", "score", ["split"], group_limit=3).withColumn("trees", F.lit(fitted.trees))


@query("m3_export_nodes")
def export(spark, d):
    """The largest difference between a trained model and its node table."""
    fitted = trained(spark, d)
    return M.verify_export(labelled(spark, d), fitted, M.export_nodes(spark, fitted))


@query("m9_permutation_importance")
def permutation(spark, d):
    """Change of importance from the first half of the trained trees to all of them, on all features."""
    fitted, rows = trained(spark, d), labelled(spark, d).where("split = 'test'")
    half = replace(fitted, trees=max(1, fitted.trees // 2))
    before = M.permutation_importance(rows, half.ensemble(spark), MODEL_FEATURES, "default", "id")
    after = M.permutation_importance(rows, fitted.ensemble(spark), MODEL_FEATURES, "default", "id")
    return M.importance_shift(before, after)


@query("m10_isotonic_fit", Q.build(["scored_lines"], f"""
SELECT {r('x')} AS x, {r('y')} AS y FROM (
  SELECT x, y, lag(y) OVER (ORDER BY x) AS b, lead(y) OVER (ORDER BY x) AS a FROM solved)
WHERE b IS NULL OR a IS NULL OR abs(b - y) > 1e-9 OR abs(a - y) > 1e-9""", {
    "points": "SELECT x, s, n, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM (SELECT q AS x, sum(label) AS s, count(*) AS n FROM scored_lines GROUP BY q)",
    "spans": "SELECT a.i AS lo, b.i AS hi, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM points a JOIN points b ON a.i <= b.i",
    "lowest": "SELECT lo, k.i AS pos, min(mean) AS m FROM spans JOIN points k ON lo <= k.i AND k.i <= hi GROUP BY lo, k.i",
    "solved": "SELECT k.x, max(m) AS y FROM lowest JOIN points k ON k.i = pos GROUP BY k.x"}))
def isotonic(spark, d):
    """The fit on the fifty quantities; SQL takes the largest over starts of the smallest mean over ends."""
    return rounded(C.fit_isotonic(V.scored_lines(spark, d), "label", "q"))


@query("m10_isotonic_fit_scores", Q.build(["scored_lines"], f"""
SELECT DISTINCT {r('unnest([first, last])', 8)} AS x, {r('s / n')} AS y FROM rounds WHERE step = (SELECT max(step) FROM rounds)""", {
    "rounds(step, first, last, s, n)": """SELECT 0, p, p, CAST(sum(label) AS BIGINT), count(*) FROM scored_lines GROUP BY p
  UNION ALL SELECT step + 1, min(first), max(last), CAST(sum(s) AS BIGINT), CAST(sum(n) AS BIGINT) FROM (
    SELECT *, sum(1 - falls) OVER (ORDER BY first) AS run, max(falls) OVER () AS any_falls FROM (
      SELECT *, CAST(coalesce(lag(s) OVER (ORDER BY first) * n >= s * lag(n) OVER (ORDER BY first), false) AS INTEGER) AS falls FROM rounds))
  WHERE any_falls = 1 GROUP BY step, run"""}).replace("WITH ", "WITH RECURSIVE ", 1))
def isotonic_scores(spark, d):
    """The fit on the exact score of the whole table; SQL pools all falling runs at once until none is left."""
    return C.fit_isotonic(V.scored_lines(spark, d), "label", "p").select(round_away("x", 8).alias("x"), round_away("y", 6).alias("y"))


REJECTED_FEATURES = ["loan_amnt", "dti", "fico_score", "emp_length", "int_rate", "annual_inc"]


def rejected(spark, d):
    raw = V.rejected_raw(spark, d)
    return silver_rejected(raw.withColumn("id", F.col("id"))), raw


@query("m15_align_rejected", Q.build(["rejected_raw", "gold"], f"""
SELECT r.id, {r('amount')} AS loan_amnt, {r("CAST(replace(dti_text, '%', '') AS DOUBLE)")} AS dti, coalesce(risk, m.fico) AS fico_score,
  {r('m.rate')} AS int_rate, {r('m.inc')} AS annual_inc FROM rejected_raw r,
  (SELECT median(fico_score) AS fico, median(int_rate) AS rate, median(annual_inc) AS inc FROM gold WHERE split = 'train') m"""))
def align(spark, d):
    raw = V.rejected_raw(spark, d).select(
        "id", F.col("Amount Requested").alias("loan_amnt"), F.regexp_replace("Debt-To-Income Ratio", "%", "").cast("double").alias("dti"),
        F.col("Risk_Score").alias("fico_score"))
    return rounded(M.align_rejected(raw, V.gold(spark, d).where("split = 'train'"), ["loan_amnt", "dti", "fico_score", "int_rate", "annual_inc"], "id"))


@query("m15_pseudo_labels", Q.build(["rejected_raw", "gold"], f"""
SELECT id, CAST(s >= (SELECT x FROM cut) AS INTEGER) AS "default" FROM bad""", {
    "bad": "SELECT id, 1 / (1 + exp((risk - 650) / 50)) AS s FROM rejected_raw WHERE risk IS NOT NULL",
    "share": "SELECT 1 - least(2 * avg(\"default\"), 0.6) AS q FROM gold WHERE split = 'train'",
    "cut": """SELECT max(s) FILTER (WHERE rk = floor(pos)) + max(pos - floor(pos)) * (max(s) FILTER (WHERE rk = least(floor(pos) + 1, n - 1)) - max(s) FILTER (WHERE rk = floor(pos))) AS x
  FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS rk, count(*) OVER () AS n, q * (count(*) OVER () - 1) AS pos FROM bad, share)"""}))
def pseudo(spark, d):
    rows = V.rejected_raw(spark, d).where("Risk_Score is not null").select(
        "id", (1 / (1 + F.exp((F.col("Risk_Score") - 650) / 50))).alias("score"))
    rate = M.reject_rate(V.gold(spark, d).where("split = 'train'")).first()["rate"]
    return M.pseudo_labels(rows, "score", rate).select("id", "default")


@query("m15_augmented_training")
def augmented_training(spark, d):
    """Carve-out rows of the augmented fit that may feed a calibrator: observed labels only."""
    rows = labelled(spark, d)
    turned = M.align_rejected(
        V.rejected_raw(spark, d).select("id", F.col("Amount Requested").alias("loan_amnt"), F.col("Risk_Score").alias("fico_score")),
        rows.where("split = 'train'"), MODEL_FEATURES, "id")
    rate = M.reject_rate(rows.where("split = 'train'")).first()["rate"]
    pseudo_rows = M.pseudo_labels(turned.withColumn("s", -F.col("fico_score")), "s", rate)
    _, observed = M.train_augmented(
        rows.where("split = 'train'"), pseudo_rows, rows.where("split = 'val'"), MODEL_FEATURES, "default", "id", M.CHAMPION)
    return observed.groupBy("default").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- comparison and verdicts

COMPARED = {
    "pool": "SELECT * FROM scored_gold WHERE split = 'test'",
    "ma": Q.auc("pool", '"default"', "score"), "mb": Q.auc("pool", '"default"', "score_b"),
    "edges": "SELECT b, b * 0.1::DOUBLE AS lo, CASE WHEN b = 9 THEN 1::DOUBLE ELSE (b + 1) * 0.1::DOUBLE END AS hi FROM range(10) t(b)",
    "sides": """SELECT b, (SELECT count(*) FROM pool WHERE score >= lo AND (CASE WHEN b = 9 THEN score <= hi ELSE score < hi END)) AS e,
  (SELECT count(*) FROM pool WHERE score_b >= lo AND (CASE WHEN b = 9 THEN score_b <= hi ELSE score_b < hi END)) AS a FROM edges""",
    "shift": """SELECT sum((sa - es) * ln(sa / es)) AS psi FROM (
  SELECT (e + 1) / (sum(e) OVER () + 10)::DOUBLE AS es, (a + 1) / (sum(a) OVER () + 10)::DOUBLE AS sa FROM sides)""",
    "clipped": """SELECT sum((sa - es) * ln(sa / es)) AS psi FROM (
  SELECT greatest(e / (sum(e) OVER ())::DOUBLE, 1e-6) AS es, greatest(a / (sum(a) OVER ())::DOUBLE, 1e-6) AS sa FROM sides)""",
}


def comparison_sql(psi: str) -> str:
    return f"""SELECT round(ma.auc, 4) AS champion_auc, round(ma.ks, 4) AS champion_ks, round(2 * ma.auc - 1, 4) AS champion_gini,
  round(mb.auc, 4) AS challenger_auc, round(mb.ks, 4) AS challenger_ks, round(2 * mb.auc - 1, 4) AS challenger_gini,
  round(round(mb.auc, 4) - round(ma.auc, 4), 4) AS auc_delta, round(round(mb.ks, 4) - round(ma.ks, 4), 4) AS ks_delta,
  round({psi}.psi, 4) AS score_psi FROM ma, mb, {psi}"""


# the challenger of the gates treats two groups worse, one of them already below the threshold
WORSE = 'least(pd_b + 0.12 * CAST(home_ownership = 2 AS INTEGER) + 0.12 * CAST(verification_status = 1 AS INTEGER), 1)'
CHAMPION, CHALLENGER = fairness_parts("pd", "_a"), fairness_parts("pd_b", "_b")
STRICT = {**fairness_parts("pd", "_a"), **fairness_parts(WORSE, "_b")}
GATE = {
    **CHAMPION, **CHALLENGER,
    "blocking": """SELECT b.attribute, b."group", CASE WHEN a.dir IS NULL OR a.dir >= 0.8
    THEN printf('%s/%s introduces a DIR violation (%.2f < %.2f)', b.attribute, b."group", b.dir, 0.8)
    WHEN b.dir < a.dir - 0.01 THEN printf('%s/%s worsens an existing DIR violation (champion %.2f -> challenger %.2f)', b.attribute, b."group", a.dir, b.dir) END AS reason
  FROM summary_b b LEFT JOIN summary_a a ON a.attribute = b.attribute AND a."group" = b."group" WHERE b.dir < 0.8""",
}


def summaries(spark, d):
    pool = V.scored_gold(spark, d).where("split = 'test'")
    return X.fairness_report(pool, "default", "pd"), X.fairness_report(pool, "default", "pd_b")


def strict_summaries(spark, d):
    pool = V.scored_gold(spark, d).where("split = 'test'").withColumn("worse", F.expr(WORSE.replace("0.12", "0.12D").replace(", 1)", ", 1D)")))
    return X.fairness_report(pool, "default", "pd"), X.fairness_report(pool, "default", "worse")


BLOCKED = {**STRICT, "blocking": GATE["blocking"]}


@query("j5_gate_reasons", Q.build(["scored_gold"], 'SELECT attribute, "group", reason FROM blocking WHERE reason IS NOT NULL', BLOCKED))
def gate_reasons(spark, d):
    return X.gate_reasons(*strict_summaries(spark, d))


@query("m16_compare_models", Q.build(["scored_gold"], comparison_sql("shift"), COMPARED))
def compare(spark, d):
    return W.compare_models(V.scored_gold(spark, d).where("split = 'test'"), "default", "score", "score_b")


@query("m16_promotion_advice", Q.build(["scored_gold"], f"""
SELECT gate, CASE WHEN gate = 'blocked' THEN 'DO NOT PROMOTE' WHEN challenger_auc - champion_auc > 0.005 THEN 'PROMOTE'
  WHEN challenger_auc - champion_auc > -0.005 THEN 'CONSIDER' ELSE 'DO NOT PROMOTE' END AS advice, score_psi
FROM ({comparison_sql('shift')}), (SELECT CASE WHEN count(reason) > 0 THEN 'blocked' ELSE 'passed' END AS gate FROM blocking)""", {**COMPARED, **GATE}))
def advice(spark, d):
    row = W.compare_models(V.scored_gold(spark, d).where("split = 'test'"), "default", "score", "score_b")
    gate = X.fairness_gate(spark, *summaries(spark, d))
    return W.promotion_advice(row, gate).select("gate", "advice", "score_psi")


@query("m16_retrain_job")
def retrain_job(spark, d):
    """A challenger trained with its shipped parameters, calibrated and compared with the champion on the test rows."""
    rows = labelled(spark, d)
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    champion = T.load_ensemble(T.node_covers(V.gold(spark, d), V.tree_nodes(spark)), V.BASELINE)
    before = X.fairness_report(T.with_probability(test, champion, "score"), "default", "score")
    return train_challenger(train, val, test, MODEL_FEATURES, "default", "id", scratch_path(spark, "retrain"), champion, before)["comparison"]


@query("m16_reject_inference_advice", Q.build(["scored_gold"], f"""
SELECT auc_delta, score_psi, violations, CASE WHEN violations <> '' THEN 'DO NOT PROMOTE' WHEN auc_delta > 0 AND score_psi < 0.25 THEN 'PROMOTE'
  WHEN auc_delta > 0 THEN 'CAUTION' ELSE 'KEEP CHAMPION' END AS advice
FROM ({comparison_sql('clipped')}), (SELECT coalesce(string_agg(attribute || '/' || "group", ', ' ORDER BY attribute || '/' || "group"), '') AS violations FROM summary_b WHERE violation)""",
                                              {**COMPARED, **CHALLENGER}))
def reject_advice(spark, d):
    row = W.compare_models(V.scored_gold(spark, d).where("split = 'test'"), "default", "score", "score_b", "clip")
    return W.reject_inference_advice(row, summaries(spark, d)[1]).select("auc_delta", "score_psi", "violations", "advice")


@query("m17_fairness_gate", Q.build(["scored_gold"], """
SELECT CASE WHEN count(reason) > 0 THEN 'blocked' ELSE 'passed' END AS gate, coalesce(string_agg(reason, '; ' ORDER BY reason), '') AS reasons FROM blocking""", BLOCKED))
def gate(spark, d):
    return X.fairness_gate(spark, *strict_summaries(spark, d)).select("gate", F.array_join("reasons", "; ").alias("reasons"))


VERDICT = """SELECT b.attribute || '/' || b."group" AS name, b.dir, a.dir AS before FROM summary_b b
  LEFT JOIN summary_a a ON a.attribute = b.attribute AND a."group" = b."group" WHERE b.violation"""


@query("m17_validation_verdict", Q.build(["scored_gold"], """
SELECT CASE WHEN count(*) FILTER (WHERE NOT coalesce(before < 0.8, false) OR dir < before - 0.01) > 0 THEN 'REVIEW REQUIRED' ELSE 'APPROVED' END AS status FROM verdict""",
                                         {**CHAMPION, **CHALLENGER, "verdict": VERDICT}))
def verdict(spark, d):
    champion, challenger = summaries(spark, d)
    return X.validation_verdict(spark, challenger, champion, True).select("status")


DRIFTED = """SELECT CASE WHEN psi > 0.25 THEN 'CRITICAL' WHEN psi > 0.1 THEN 'WARNING' ELSE 'OK' END AS psi_status, round(psi, 4) AS psi FROM log_shift"""
LOG_SHIFT = {
    "edges": COMPARED["edges"],
    "latest": "SELECT score FROM scoring_log WHERE model_version = 'v1.1'",
    "train": "SELECT score FROM scored_gold WHERE split = 'train'",
    "counts": """SELECT b, (SELECT count(*) FROM train WHERE score >= lo AND (CASE WHEN b = 9 THEN score <= hi ELSE score < hi END)) AS e,
  (SELECT count(*) FROM latest WHERE score >= lo AND (CASE WHEN b = 9 THEN score <= hi ELSE score < hi END)) AS a FROM edges""",
    "log_shift": """SELECT sum((sa - es) * ln(sa / es)) AS psi FROM (
  SELECT (e + 1) / (sum(e) OVER () + 10)::DOUBLE AS es, (a + 1) / (sum(a) OVER () + 10)::DOUBLE AS sa FROM counts)""",
    "drift": """SELECT round(psi, 4) AS psi, n, CASE WHEN n < 500 THEN 'INSUFFICIENT_DATA' WHEN psi > 0.25 THEN 'CRITICAL' WHEN psi > 0.1 THEN 'WARNING' ELSE 'OK' END AS status
  FROM log_shift, (SELECT count(*) AS n FROM latest)""",
}


def drift_of(spark, d):
    train = V.scored_gold(spark, d).where("split = 'train'").select("score")
    latest = logged_scores(V.scoring_log(spark, d), "v1.1")
    return W.drift_verdict(S.psi(train, latest, "score"), latest.agg(F.count(F.lit(1))).scalar(), None, True)


@query("m20_drift_verdict", Q.build(["scored_gold", "scoring_log"], """
SELECT psi, status AS psi_status, n AS n_observations, n >= 500 AS monitoring_eligible, n >= 500 AND status = 'CRITICAL' AS needs_retrain FROM drift""", LOG_SHIFT))
def drift_verdict(spark, d):
    return drift_of(spark, d).select("psi", "psi_status", "n_observations", "monitoring_eligible", "needs_retrain")


@query("m20_drift_report", Q.build(["scored_gold", "scoring_log"], """
SELECT psi, status AS psi_status, n AS n_observations, n >= 500 AND status = 'CRITICAL' AS needs_retrain FROM drift""", LOG_SHIFT))
def drift_report(spark, d):
    """The whole drift job on the logged decisions."""
    from riskframe.plans.monitoring import drift

    rows = V.gold(spark, d)
    return drift(rows.where("split = 'train'"), rows.where("split = 'test'"), V.scoring_log(spark, d), V.ensemble(spark), "v1.1", USED).select(
        "psi", "psi_status", "n_observations", "needs_retrain")


MATURED = "SELECT score AS s, CAST(actual_default AS INTEGER) AS label FROM scoring_log WHERE model_version = 'v1.1' AND actual_default IS NOT NULL"
POWER = {
    "matured": MATURED, "power": Q.auc("matured", "label", "s"), **decile_parts("matured", "label", "s"),
    "judged": """SELECT n, round(auc, 4) AS auc, round(ks, 4) AS ks, round(0.7 - auc, 4) AS auc_drop, rank_order_breaks, 0.7 - auc > 0.03 AS needs_retrain FROM power, broken""",
}


def power_of(spark, d):
    cohort = logged_outcomes(V.scoring_log(spark, d), "v1.1")
    return W.performance_verdict(cohort, "label", "score", {"test": 0.7})


@query("m21_performance_verdict", Q.build(["scoring_log"], """
SELECT n AS n_observations, auc, ks, auc_drop, rank_order_breaks, needs_retrain FROM judged""", POWER))
def performance_verdict(spark, d):
    return power_of(spark, d).select("n_observations", "auc", "ks", "auc_drop", "rank_order_breaks", "needs_retrain")


@query("m22_retrain_decision", Q.build(["scored_gold", "scoring_log"], """
SELECT CASE WHEN (n >= 500 AND status = 'CRITICAL') OR p.needs_retrain THEN 'retrain' ELSE 'skip_retrain' END AS decision,
  concat_ws(', ', CASE WHEN n >= 500 AND status = 'CRITICAL' THEN printf('psi_critical (%.4f)', psi) END,
                  CASE WHEN p.needs_retrain THEN printf('auc_drop (%.4f)', p.auc_drop) END) AS reason
FROM drift, (SELECT needs_retrain, auc_drop FROM judged) p""", {**LOG_SHIFT, **POWER}))
def retrain(spark, d):
    return W.retrain_decision([drift_of(spark, d), power_of(spark, d)])


# ---------------------------------------------------------------- the whole question

@query("flagship_scored_cohorts", Q.build(["scored_gold"], f"""
SELECT split, n, {r('default_rate')} AS default_rate, {r('approval_rate')} AS approval_rate, {r('auc')} AS auc FROM
  (SELECT split, avg("default") AS default_rate, avg(CAST(pd < 0.15 AS INTEGER)) AS approval_rate FROM scored_gold GROUP BY split)
  JOIN ({Q.auc('scored_gold', '"default"', 'score', 'split')}) USING (split)"""))
def flagship(spark, d):
    """Raw loans to gold to decisions: does the score still rank risk in the newest cohort?"""
    rows = T.with_probability(V.fresh_gold(spark, d), V.ensemble(spark)).withColumn("pd", calibrated(F.col("score"), *V.CALIBRATOR))
    rates = rows.groupBy("split").agg(
        F.avg(F.col("default").cast("double")).alias("default_rate"),
        F.avg((decision(F.col("pd")) == "approve").cast("double")).alias("approval_rate"))
    power = ranking_metrics(rows, "default", "score", ["split"], group_limit=3).select("split", "n", "auc")
    return rounded(rates.join(F.broadcast(power), "split").select("split", "n", "default_rate", "approval_rate", "auc"))
