"""The views of ``views.py`` as SQL, and a builder that strings them together."""

from __future__ import annotations

from riskframe.functions.tables import FEATURES, MEDIAN_COLUMNS

from checks.views import BASELINE, CALIBRATOR, NOW, TRAIN_END, VALIDATION_END

EMP = """CASE k % 13 WHEN 0 THEN 'n/a' WHEN 1 THEN '< 1 year' WHEN 2 THEN '1 year'
  WHEN 11 THEN '10+ years' WHEN 12 THEN NULL ELSE (k % 13 - 1)::VARCHAR || ' years' END"""


def emp_years(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR lower(trim({c})) = 'n/a' THEN NULL WHEN trim({c}) LIKE '< 1%' THEN 0 "
        f"WHEN trim({c}) LIKE '10+%' THEN 10 ELSE CAST(split_part(trim({c}), ' ', 1) AS INTEGER) END"
    )


VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


view("keyed", [], """
SELECT o_orderkey AS k, o_totalprice AS price, o_orderdate, o_orderstatus, o_orderpriority, o_custkey,
       c_acctbal, c_mktsegment, c_nationkey
FROM orders JOIN customer ON o_custkey = c_custkey""")

view("loans_raw", ["keyed"], f"""
SELECT k AS id,
  strftime(o_orderdate, '%b-%Y') AS issue_d,
  strftime(o_orderdate - to_months(CAST(24 + k % 300 AS INTEGER)), '%b-%Y') AS earliest_cr_line,
  price / 10 AS loan_amnt, price / 10 * 0.033::DOUBLE AS installment,
  CASE WHEN k % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
  (5 + k % 24)::VARCHAR || '.' || lpad((k % 100)::VARCHAR, 2, '0') || '%' AS int_rate,
  substr('ABCDEFG', CAST(k % 7 + 1 AS INTEGER), 1) AS grade,
  substr('ABCDEFG', CAST(k % 7 + 1 AS INTEGER), 1) || (k % 5 + 1)::VARCHAR AS sub_grade,
  {EMP} AS emp_length,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'MORTGAGE' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'RENT'
       WHEN c_mktsegment = 'BUILDING' THEN 'OWN' ELSE 'ANY' END AS home_ownership,
  (c_acctbal + 1000) * 12 AS annual_inc,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Verified' WHEN '2' THEN 'Verified'
       WHEN '3' THEN 'Source Verified' ELSE 'Not Verified' END AS verification_status,
  lower(c_mktsegment) AS purpose,
  CASE WHEN k % 53 <> 0 THEN CAST(k % 108 AS DOUBLE) END AS dti,
  CASE WHEN k % 61 <> 0 THEN CAST((k % 4) // 2 AS DOUBLE) END AS delinq_2yrs,
  CASE WHEN k % 47 <> 0 THEN CAST((k % 5) // 2 AS DOUBLE) END AS mort_acc,
  CASE WHEN k % 59 <> 0 THEN CAST(k % 121 AS DOUBLE) END AS revol_util,
  CASE WHEN k % 2 <> 0 THEN CAST(k % 90 AS DOUBLE) END AS mths_since_last_delinq,
  CAST(k % 4 AS DOUBLE) AS inq_last_6mths, CAST(2 + k % 28 AS DOUBLE) AS open_acc,
  CAST((k % 10) // 9 AS DOUBLE) AS pub_rec, CAST(4 + k % 56 AS DOUBLE) AS total_acc,
  CAST((k % 12) // 11 AS DOUBLE) AS pub_rec_bankruptcies, price / 20 AS revol_bal,
  CAST(620 + k % 230 AS DOUBLE) AS fico_range_low, CAST(624 + k % 230 AS DOUBLE) AS fico_range_high,
  CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'Charged Off'
       WHEN o_orderstatus IN ('F', 'O') THEN 'Fully Paid' ELSE 'Current' END AS loan_status
FROM keyed""")

view("rejected_raw", ["keyed"], f"""
SELECT k AS id, price / 10 AS amount, CASE WHEN k % 71 <> 0 THEN CAST(550 + k % 200 AS DOUBLE) END AS risk,
  (k % 90)::VARCHAR || '%' AS dti_text, {EMP} AS emp_text, CAST(o_orderdate AS DATE) AS applied, n_name AS state
FROM keyed JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'""")

view("cleaned", ["loans_raw"], f"""
SELECT id, CAST(strptime(issue_d, '%b-%Y') AS DATE) AS issue_d, loan_amnt, installment, annual_inc, dti, delinq_2yrs,
  inq_last_6mths, coalesce(mths_since_last_delinq, 999) AS mths_since_last_delinq, open_acc, pub_rec, revol_bal,
  revol_util, total_acc, mort_acc, pub_rec_bankruptcies,
  CAST(replace(trim(term), ' months', '') AS INTEGER) AS term,
  CAST(replace(int_rate, '%', '') AS DOUBLE) AS int_rate, grade, sub_grade,
  coalesce({emp_years('emp_length')}, -1) AS emp_length,
  CASE WHEN {emp_years('emp_length')} IS NULL THEN 1 ELSE 0 END AS emp_length_missing,
  home_ownership, verification_status, purpose,
  CAST(round_even(date_diff('day', CAST(strptime(earliest_cr_line, '%b-%Y') AS DATE),
       CAST(strptime(issue_d, '%b-%Y') AS DATE)) / 30.44::DOUBLE, 0) AS BIGINT) AS credit_history_months,
  CAST(round_even((fico_range_low + fico_range_high) / 2, 0) AS INTEGER) AS fico_score,
  CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS "default"
FROM loans_raw WHERE loan_status IN ('Charged Off', 'Fully Paid')""")

view("medians", ["cleaned"], "SELECT " + ", ".join(f"median({c}) AS {c}" for c in MEDIAN_COLUMNS) + " FROM cleaned")

view("filled", ["cleaned", "medians"], "SELECT c.* REPLACE (" + ", ".join(
    f"coalesce(c.{c}, m.{c}) AS {c}" for c in MEDIAN_COLUMNS) + ") FROM cleaned c, medians m")

view("silver", ["filled"], """
SELECT * FROM filled WHERE annual_inc >= 0 AND dti BETWEEN 0 AND 100 AND fico_score BETWEEN 300 AND 850""")

view("grouped_home", ["silver"], """
SELECT * REPLACE (CASE WHEN home_ownership IN ('RENT', 'OWN', 'MORTGAGE') THEN home_ownership ELSE 'OTHER' END AS home_ownership)
FROM silver""")

view("categories", ["grouped_home"], """
SELECT "column", category, CAST(row_number() OVER (PARTITION BY "column" ORDER BY category) - 1 AS INTEGER) AS code FROM (
  SELECT DISTINCT 'purpose' AS "column", purpose AS category FROM grouped_home
  UNION SELECT DISTINCT 'verification_status', verification_status FROM grouped_home
  UNION SELECT DISTINCT 'home_ownership', home_ownership FROM grouped_home)""")

view("gold_wide", ["grouped_home", "categories"], """
SELECT g.* REPLACE (cp.code AS purpose, cv.code AS verification_status, ch.code AS home_ownership),
  ln(1 + annual_inc) AS log_annual_inc,
  coalesce(loan_amnt / nullif(annual_inc, 0), 0) AS loan_to_income,
  coalesce(installment / nullif(annual_inc / 12, 0), 0) AS installment_to_income,
  dti * annual_inc / 1000 AS dti_x_income,
  CASE WHEN delinq_2yrs > 0 THEN 1 ELSE 0 END AS delinq_ever,
  CASE WHEN revol_util > 75 THEN 1 ELSE 0 END AS high_utilization,
  CASE WHEN mort_acc > 0 THEN 1 ELSE 0 END AS has_mortgage,
  CASE WHEN pub_rec_bankruptcies > 0 THEN 1 ELSE 0 END AS has_bankruptcy,
  ascii(grade) - 64 AS grade_numeric,
  (ascii(sub_grade) - 65) * 5 + CAST(substr(sub_grade, 2, 1) AS INTEGER) AS sub_grade_numeric
FROM grouped_home g
LEFT JOIN categories cp ON cp."column" = 'purpose' AND cp.category = g.purpose
LEFT JOIN categories cv ON cv."column" = 'verification_status' AND cv.category = g.verification_status
LEFT JOIN categories ch ON ch."column" = 'home_ownership' AND ch.category = g.home_ownership""")

view("gold", ["gold_wide"], f"""
SELECT id, CAST("default" AS INTEGER) AS "default",
  CASE WHEN issue_d < DATE '{TRAIN_END}' THEN 'train' WHEN issue_d < DATE '{VALIDATION_END}' THEN 'val' ELSE 'test' END AS split,
  """ + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES) + " FROM gold_wide")

view("model_input", ["cleaned"], """
SELECT id, issue_d, "default", coalesce(loan_amnt / nullif(annual_inc, 0), 0) AS loan_to_income, dti,
  CAST(fico_score AS DOUBLE) AS fico_score FROM cleaned""")


# the three trees of views.TREES, written out
TREE0 = "CASE WHEN fico_score IS NULL OR fico_score <= 700 THEN CASE WHEN dti IS NULL OR dti <= 40 THEN -0.2 ELSE 0.6 END ELSE -0.9 END::DOUBLE"
TREE1 = "CASE WHEN loan_to_income IS NULL OR loan_to_income <= 0.35 THEN -0.5 ELSE CASE WHEN fico_score <= 680 THEN 0.8 ELSE 0.1 END END::DOUBLE"
TREE2 = "CASE WHEN dti <= 60 THEN CASE WHEN dti <= 20 THEN -0.4 ELSE 0.05 END ELSE CASE WHEN loan_to_income <= 0.2 THEN 0.3 ELSE 0.7 END END::DOUBLE"
RAW3 = f"({BASELINE}::DOUBLE + ({TREE0}) + ({TREE1}) + ({TREE2}))"
RAW2 = f"({BASELINE}::DOUBLE + ({TREE0}) + ({TREE1}))"


def probability(raw: str) -> str:
    return f"1 / (1 + exp(-({raw})))"


def apply_calibrator(p: str) -> str:
    xs, ys = CALIBRATOR
    whens = [f"WHEN {p} <= {xs[0]}::DOUBLE THEN {ys[0]}::DOUBLE", f"WHEN {p} >= {xs[-1]}::DOUBLE THEN {ys[-1]}::DOUBLE"]
    for i in range(1, len(xs)):
        whens.append(
            f"WHEN {p} <= {xs[i]}::DOUBLE THEN ({ys[i]}::DOUBLE - {ys[i-1]}::DOUBLE) / ({xs[i]}::DOUBLE - {xs[i-1]}::DOUBLE)"
            f" * ({p} - {xs[i-1]}::DOUBLE) + {ys[i-1]}::DOUBLE"
        )
    return "CASE " + " ".join(whens) + " END"


def points(pd: str) -> str:
    p = f"least(greatest({pd}, 1e-6), 1 - 1e-6)"
    return (
        f"CAST(floor((600 - 20 / ln(2) * ln(30)) + 20 / ln(2) * ln((1 - {p}) / {p}) + 0.5) AS INTEGER)"
    )


def decision(pd: str) -> str:
    return f"CASE WHEN {pd} < 0.15 THEN 'approve' WHEN {pd} < 0.30 THEN 'review' ELSE 'decline' END"


view("scored_gold_raw", ["gold"], f"SELECT *, {probability(RAW3)} AS score, {probability(RAW2)} AS score_b FROM gold")
view("scored_gold", ["scored_gold_raw"], f"SELECT *, {apply_calibrator('score')} AS pd, {apply_calibrator('score_b')} AS pd_b FROM scored_gold_raw")

view("scored_lines", [], """
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice / 1e5::DOUBLE AS p, l_quantity / 50 AS q,
  l_orderkey, l_linestatus, l_shipdate FROM lineitem""")

view("scoring_log", [], f"""
SELECT event_id AS request_id, 'LC_' || user_id::VARCHAR AS applicant_id, ts AS scored_at,
  'v1.' || (event_id % 3)::VARCHAR AS model_version, least(value / 500, 1) AS score, value,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
  {decision('least(value / 500, 1)')} AS decision,
  CASE event_type WHEN 'error' THEN true WHEN 'purchase' THEN false END AS actual_default,
  CASE WHEN event_type IN ('error', 'purchase') THEN ts + INTERVAL 7 DAY END AS outcome_observed_at
FROM events""")

view("outcomes", [], """
SELECT o_custkey AS id, 2 * count(*) FILTER (WHERE o_orderstatus = 'F') > count(*) AS label
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY' GROUP BY o_custkey""")

view("drift_log", [], """
SELECT date_trunc('day', ts) AS measured_at, event_type AS metric_name, round(avg(value), 5) AS metric_value,
  'v1.' || (max(event_id) % 3)::VARCHAR AS model_version FROM events GROUP BY 1, 2""")

view("feature_store", ["gold"], f"""
SELECT 'LC_' || id::VARCHAR AS applicant_id, CASE WHEN split = 'train' THEN 2 ELSE 1 END AS feature_version,
  TIMESTAMP '{NOW}' - to_days(CAST(id % 40 AS INTEGER)) AS computed_at, split = 'val' AS lacks_dti,
  id, loan_to_income, dti, CAST(fico_score AS INTEGER) AS fico_score, CAST(grade_numeric AS INTEGER) AS grade
FROM gold""")

view("requests", [], """
SELECT 'o' || o_orderkey::VARCHAR AS request_id, 'LC_' || o_orderkey::VARCHAR AS applicant_id FROM orders
UNION ALL SELECT 'c' || c_custkey::VARCHAR, c_name FROM customer""")


def build(views: list[str], select: str, extra: dict[str, str] | None = None) -> str:
    """A WITH query over the named views (in dependency order) and extra ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


# ---------------------------------------------------------------- statistics in SQL

def auc(source: str, label: str, score: str, keys: str = "") -> str:
    """Midrank AUC and KS of a relation, per group of ``keys``."""
    by = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {lead}CAST(sum(pos + neg) AS BIGINT) AS n,
  CASE WHEN max(tp) > 0 AND max(tn) > 0 THEN sum(pos * (below_neg + neg / 2.0::DOUBLE)) / (max(tp)::DOUBLE * max(tn)::DOUBLE) END AS auc,
  CASE WHEN max(tp) > 0 AND max(tn) > 0 THEN greatest(0, max(below_neg::DOUBLE / nullif(tn, 0) - below_pos::DOUBLE / nullif(tp, 0))) END AS ks
FROM (
  SELECT {lead}s, pos, neg,
    coalesce(sum(neg) OVER ({by}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_neg,
    coalesce(sum(pos) OVER ({by}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_pos,
    sum(pos) OVER ({by.strip()}) AS tp, sum(neg) OVER ({by.strip()}) AS tn
  FROM (SELECT {lead}{score} AS s, sum({label}) AS pos, sum(1 - {label}) AS neg FROM {source} GROUP BY {lead}{score})
) {group}"""


def quantiles(source: str, value: str, probabilities: list[float], keys: str = "") -> str:
    """Interpolated quantiles, one row per (keys, q), from row numbers."""
    by = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    levels = ", ".join(f"({p!r}::DOUBLE)" for p in probabilities)
    group = f"GROUP BY {lead}q"
    return f"""
SELECT {lead}q, max(CASE WHEN rk = lo THEN v END)
    + max(frac) * (max(CASE WHEN rk = hi THEN v END) - max(CASE WHEN rk = lo THEN v END)) AS x
FROM (
  SELECT r.*, q, CAST(floor(q * (n - 1)) AS BIGINT) AS lo,
    least(CAST(floor(q * (n - 1)) AS BIGINT) + 1, n - 1) AS hi, q * (n - 1) - floor(q * (n - 1)) AS frac
  FROM (SELECT {lead}{value} AS v, row_number() OVER ({by}ORDER BY {value}) - 1 AS rk, count(*) OVER ({by.strip()}) AS n
        FROM {source} WHERE {value} IS NOT NULL) r, (VALUES {levels}) AS p(q)
) WHERE rk IN (lo, hi) {group}"""
