"""Sources, silver, gold and quality queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks import sql as Q, views as V
from riskframe.functions.numeric import round_away
from checks.registry import query, rounded, stamp
from riskframe.functions import parsing
from riskframe.functions.tables import BINARY_COLUMNS, FEATURES, HOME_KEPT, MEDIAN_COLUMNS, ORIGINATION_COLUMNS, PROTECTED_ATTRIBUTES
from riskframe.operators import gold as G, quality as D, silver as P
from riskframe.session import scratch_path
from riskframe.sources import feature_store as store, layers

RAW_COLUMNS = ["id", "issue_d", *ORIGINATION_COLUMNS, "loan_status"]
NUMERIC = [f for f in FEATURES]


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


# ---------------------------------------------------------------- sources

@query("s1_read_raw_csv", Q.build(["loans_raw"], f"""
SELECT id, issue_d, {r('loan_amnt')} AS loan_amnt, term, int_rate, emp_length, {r('dti')} AS dti, loan_status,
  '2024-02-15T00:00:00' AS ingested_at, true AS has_source FROM loans_raw"""))
def read_raw_csv(spark, d):
    path = scratch_path(spark, "raw-csv")
    V.loans_view(spark, d).select(*RAW_COLUMNS).write.option("header", True).option("compression", "gzip").option(
        "ignoreLeadingWhiteSpace", False).option("quote", '"').option("escape", '"').csv(path)
    raw = layers.read_raw_csv(spark, path, RAW_COLUMNS, datetime(2024, 2, 15), partitions=8)
    return rounded(raw.select(
        F.col("id").cast("bigint").alias("id"), "issue_d", F.col("loan_amnt").cast("double").alias("loan_amnt"), "term",
        "int_rate", "emp_length", F.col("dti").cast("double").alias("dti"), "loan_status", "ingested_at",
        F.col("source_file").endswith(".csv.gz").alias("has_source")))


@query("s2_write_once_layer", Q.build(["silver"], f"SELECT id, \"default\", fico_score, {r('annual_inc')} AS annual_inc FROM silver"))
def write_once_layer(spark, d):
    path = scratch_path(spark, "silver")
    rows = V.fresh_silver(spark, d).select("id", "default", "fico_score", "annual_inc")
    layers.write_once(rows, path)
    if layers.write_once(rows.limit(0), path):
        raise AssertionError("a complete layer was written again")
    return rounded(spark.read.parquet(path))


@query("s3_read_numeric_columns", f"""
SELECT {r('l_quantity')} AS l_quantity, {r('l_extendedprice')} AS l_extendedprice, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem""")
def read_numeric(spark, d):
    return rounded(layers.read_numeric(spark, f"{d}/lineitem.parquet", ["l_quantity", "l_extendedprice", "l_quantity", "l_linenumber"]))


@query("s4_upsert_snapshots", Q.build(["gold"], """
SELECT 'LC_' || id::VARCHAR AS applicant_id, 1 AS feature_version,
  CASE WHEN split = 'train' THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END AS computed_at,
  round(1.0::DOUBLE, 3) AS data_completeness, CAST(fico_score AS INTEGER) AS fico_score, CAST(grade_numeric AS INTEGER) AS grade FROM gold
UNION ALL SELECT 'LC_' || id::VARCHAR, 2, '2024-01-01 00:00:00', round(1.0::DOUBLE, 3), CAST(fico_score AS INTEGER), CAST(grade_numeric AS INTEGER)
FROM gold WHERE split = 'train'"""))
def upsert_snapshots(spark, d):
    """Read back from a store of two feature versions after a batch of the first: one partition is written anew."""
    rows, features = V.gold(spark, d), list(FEATURES)
    at = lambda day: F.lit(f"2024-{day} 00:00:00").cast("timestamp")
    table = store.feature_table(spark, scratch_path(spark, "features"))
    first = store.snapshots(rows.where("split <> 'test'"), features, 1, at("01-01"))
    store.write_upsert(table, first.unionByName(store.snapshots(rows.where("split = 'train'"), features, 2, at("01-01"))))
    store.write_upsert(table, store.snapshots(rows.where("split <> 'train'"), features, 1, at("02-01")))
    return table.read().select(
        "applicant_id", "feature_version", stamp("computed_at"), "data_completeness", "fico_score", "grade")


PACKED = ["annual_inc", "delinq_2yrs", "dti", "mort_acc", "revol_util"]


@query("s5_pack_features", Q.build(["cleaned"], f"""
SELECT 'LC_' || id::VARCHAR AS applicant_id, feature, {r('value')} AS value,
  round(({' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in PACKED)}) / 5.0::DOUBLE, 3) AS data_completeness
FROM cleaned, LATERAL (VALUES {', '.join(f"('{c}', {c})" for c in PACKED)}) AS x(feature, value)"""))
def pack_features(spark, d):
    rows = G.grade_numbers(V.cleaned(spark, d))
    packed = store.snapshots(rows, PACKED, 1, V.now())
    return rounded(packed.select("applicant_id", F.explode("features").alias("feature", "value"), "data_completeness"))


@query("s6_training_distribution", Q.build(["scored_gold"], f"""
SELECT 'v1.1' AS model_version, CAST(b AS INTEGER) AS bin, {r('CASE WHEN b = 10 THEN 1 ELSE b * 0.1::DOUBLE END')} AS low_edge, (
  SELECT count(*) FROM scored_gold WHERE split = 'train' AND score >= b * 0.1::DOUBLE
    AND (CASE WHEN b = 9 THEN score <= 1 ELSE score < (b + 1) * 0.1::DOUBLE END)) AS n,
  (SELECT count(*) FROM scored_gold WHERE split = 'train') AS total_count FROM range(10) t(b)"""))
def training_distribution(spark, d):
    rows = V.scored_gold(spark, d).where("split = 'train'")
    one = store.training_distribution(rows, "score", "v1.1")
    return rounded(one.select(
        "model_version", F.posexplode("bin_counts").alias("bin", "n"), "bin_edges", "total_count"
    ).select("model_version", "bin", F.get("bin_edges", "bin").alias("low_edge"), "n", "total_count"))


@query("s9_feature_metadata", Q.build(["gold", "categories"], """
SELECT 'rows' AS kind, split AS name, CAST(count(*) AS DOUBLE) AS value FROM gold GROUP BY split
UNION ALL SELECT 'default_rate', split, round(avg("default"), 4) FROM gold GROUP BY split
UNION ALL SELECT 'code', "column" || '/' || category, CAST(code AS DOUBLE) FROM categories"""))
def feature_metadata(spark, d):
    doc = store.feature_metadata(V.gold(spark, d), V.categories(spark, d), list(FEATURES), 1)
    parsed = doc.select(F.from_json(
        "metadata",
        "splits map<string, struct<rows: double, default_rate: double>>, categorical_encodings map<string, map<string, int>>",
    ).alias("m"))
    splits = parsed.select(F.explode("m.splits").alias("name", "s"))
    codes = parsed.select(F.explode("m.categorical_encodings").alias("c", "m")).select("c", F.explode("m").alias("t", "v"))
    return (
        splits.select(F.lit("rows").alias("kind"), "name", F.col("s.rows").alias("value"))
        .unionByName(splits.select(F.lit("default_rate").alias("kind"), "name", F.col("s.default_rate").alias("value")))
        .unionByName(codes.select(F.lit("code").alias("kind"), F.concat_ws("/", "c", "t").alias("name"), F.col("v").cast("double").alias("value")))
    )


# ---------------------------------------------------------------- silver

@query("p1_resolved_loans", Q.build(["loans_raw"], """
SELECT id, CAST(loan_status = 'Charged Off' AS INTEGER) AS "default" FROM loans_raw WHERE loan_status <> 'Current'"""))
def resolved(spark, d):
    return P.resolved_loans(V.loans_raw(spark, d)).select("id", "default")


@query("p2_origination_only", Q.build(["loans_raw"], "SELECT issue_d, id, " + ", ".join(
    r(c) + f" AS {c}" if c not in ("term", "int_rate", "grade", "sub_grade", "emp_length", "home_ownership", "verification_status", "purpose", "earliest_cr_line") else c
    for c in ORIGINATION_COLUMNS) + ", CAST(loan_status = 'Charged Off' AS INTEGER) AS \"default\" FROM loans_raw WHERE loan_status <> 'Current'"))
def origination(spark, d):
    return rounded(P.origination_only(P.resolved_loans(V.loans_raw(spark, d))))


@query("p3_drop_incomplete", Q.build(["loans_raw"], """
SELECT id, loan_status FROM loans_raw WHERE dti IS NOT NULL AND revol_util IS NOT NULL AND emp_length IS NOT NULL"""))
def incomplete(spark, d):
    return P.drop_incomplete(V.loans_raw(spark, d), ("dti", "revol_util", "emp_length")).select("id", "loan_status")


@query("p4_parse_term", Q.build(["loans_raw"], """
SELECT id, CAST(regexp_extract(term, '\\d+') AS INTEGER) AS months FROM loans_raw"""))
def parse_term(spark, d):
    return V.loans_raw(spark, d).select("id", parsing.term_months(F.col("term")).alias("months"))


@query("p5_parse_employment", Q.build(["loans_raw"], f"SELECT id, {Q.emp_years('emp_length')} AS years FROM loans_raw"))
def parse_employment(spark, d):
    return V.loans_raw(spark, d).select("id", parsing.employment_years(F.col("emp_length")).alias("years"))


@query("p6_parse_percent", Q.build(["loans_raw", "rejected_raw"], f"""
SELECT 'accepted' AS source, id, {r("CAST(replace(int_rate, '%', '') AS DOUBLE)")} AS rate, CAST(NULL AS DOUBLE) AS lenient FROM loans_raw
UNION ALL SELECT 'rejected', id, {r("CAST(replace(dti_text, '%', '') AS DOUBLE)")}, {r("TRY_CAST(replace(emp_text, '%', '') AS DOUBLE)")} FROM rejected_raw"""))
def parse_percent(spark, d):
    a = V.loans_raw(spark, d).select(
        F.lit("accepted").alias("source"), "id", parsing.percent(F.col("int_rate")).alias("rate"), F.lit(None).cast("double").alias("lenient"))
    b = V.rejected_raw(spark, d).select(
        F.lit("rejected").alias("source"), "id", parsing.percent(F.col("Debt-To-Income Ratio"), strict=False).alias("rate"),
        parsing.percent(F.col("Employment Length"), strict=False).alias("lenient"))
    return rounded(a.unionByName(b))


@query("p7_credit_history_months", Q.build(["loans_raw"], """
SELECT id, CAST(round_even(date_diff('day', CAST(strptime(earliest_cr_line, '%b-%Y') AS DATE),
  CAST(strptime(issue_d, '%b-%Y') AS DATE)) / 30.44::DOUBLE, 0) AS BIGINT) AS months FROM loans_raw"""))
def history_months(spark, d):
    return V.loans_raw(spark, d).select("id", parsing.months_between_half_even(
        parsing.month_date(F.col("earliest_cr_line")), parsing.month_date(F.col("issue_d"))).alias("months"))


@query("p8_mid_fico", Q.build(["loans_raw"], """
SELECT id, CAST(round_even((fico_range_low + fico_range_high + 1) / 2, 0) AS INTEGER) AS fico FROM loans_raw"""))
def mid_fico(spark, d):
    # one point wider at the top, so that halves occur
    return V.loans_raw(spark, d).select("id", parsing.midpoint_half_even(F.col("fico_range_low"), F.col("fico_range_high") + 1).alias("fico"))


@query("p9_sentinel_fills", Q.build(["cleaned"], "SELECT id, mths_since_last_delinq, emp_length, emp_length_missing FROM cleaned"))
def sentinels(spark, d):
    return V.cleaned(spark, d).select("id", "mths_since_last_delinq", "emp_length", "emp_length_missing")


@query("p10_column_medians", Q.build(["medians"], " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(c)} AS median FROM medians" for c in MEDIAN_COLUMNS)))
def medians(spark, d):
    return rounded(P.column_medians(V.cleaned(spark, d)))


@query("p10_median_fill", Q.build(["filled"], "SELECT id, " + ", ".join(f"{r(c)} AS {c}" for c in MEDIAN_COLUMNS) + " FROM filled"))
def median_fill(spark, d):
    return rounded(P.fill_medians(V.cleaned(spark, d)).select("id", *MEDIAN_COLUMNS))


@query("p11_range_gate", Q.build(["silver"], f"SELECT id, {r('dti')} AS dti, {r('annual_inc')} AS annual_inc, fico_score FROM silver"))
def range_gate(spark, d):
    return rounded(V.fresh_silver(spark, d).select("id", "dti", "annual_inc", "fico_score"))


@query("p11_range_failures", Q.build(["filled"], """
SELECT count(*) AS rows_in, count(*) FILTER (WHERE NOT annual_inc >= 0) AS bad_income,
  count(*) FILTER (WHERE annual_inc >= 0 AND dti NOT BETWEEN 0 AND 100) AS bad_dti,
  count(*) FILTER (WHERE annual_inc >= 0 AND dti BETWEEN 0 AND 100 AND fico_score NOT BETWEEN 300 AND 850) AS bad_fico,
  count(*) FILTER (WHERE annual_inc >= 0 AND dti BETWEEN 0 AND 100 AND fico_score BETWEEN 300 AND 850) AS rows_out FROM filled"""))
def range_failures(spark, d):
    return P.range_failures(P.fill_medians(V.cleaned(spark, d)))


@query("p12_rejected_applicants", Q.build(["rejected_raw"], f"""
SELECT {r('amount')} AS loan_amnt, risk AS fico_score, {r("CAST(replace(dti_text, '%', '') AS DOUBLE)")} AS dti,
  coalesce({Q.emp_years('emp_text')}, -1) AS emp_length, CASE WHEN {Q.emp_years('emp_text')} IS NULL THEN 1 ELSE 0 END AS emp_length_missing,
  state, strftime(applied, '%Y-%m-%d') AS application_date, CAST(NULL AS INTEGER) AS "default" FROM rejected_raw WHERE risk IS NOT NULL"""))
def rejected(spark, d):
    return rounded(P.silver_rejected(V.rejected_raw(spark, d)).withColumn("application_date", F.date_format("application_date", "yyyy-MM-dd")))


@query("p13_loan_id_of_applicant", Q.build(["requests"], """
SELECT request_id, CASE WHEN applicant_id LIKE 'LC\\_%' ESCAPE '\\' THEN TRY_CAST(substr(applicant_id, 4) AS BIGINT) END AS loan_id,
  CASE WHEN applicant_id LIKE 'LC\\_%' ESCAPE '\\' THEN applicant_id END AS again FROM requests"""))
def loan_ids(spark, d):
    return V.requests(spark, d).withColumn("loan_id", parsing.loan_id(F.col("applicant_id"))).select(
        "request_id", "loan_id", parsing.applicant_id(F.col("loan_id")).alias("again"))


@query("p14_applicant_id_check", Q.build(["requests"], """
SELECT request_id, CASE WHEN NOT regexp_full_match(applicant_id, '[A-Za-z0-9_-]+')
  THEN 'applicant_id may contain only letters, digits, ''_'' and ''-''' END AS problem FROM requests"""))
def id_check(spark, d):
    return V.requests(spark, d).select("request_id", parsing.applicant_id_problem(F.col("applicant_id")).alias("problem"))


# ---------------------------------------------------------------- gold

@query("g1_income_ratios", Q.build(["cleaned"], f"""
SELECT id, {r('ln(1 + annual_inc)')} AS log_annual_inc, {r('coalesce(loan_amnt / nullif(annual_inc, 0), 0)')} AS loan_to_income,
  {r('coalesce(installment / nullif(annual_inc / 12, 0), 0)')} AS installment_to_income, {r('dti * annual_inc / 1000')} AS dti_x_income FROM cleaned"""))
def ratios(spark, d):
    rows = G.income_ratios(V.cleaned(spark, d))
    return rounded(rows.select("id", "log_annual_inc", "loan_to_income", "installment_to_income", "dti_x_income"))


@query("g2_grade_numbers", Q.build(["loans_raw"], """
SELECT id, ascii(grade) - 64 AS grade_numeric, (ascii(sub_grade) - 65) * 5 + CAST(substr(sub_grade, 2, 1) AS INTEGER) AS sub_grade_numeric FROM loans_raw"""))
def grades(spark, d):
    return G.grade_numbers(V.loans_raw(spark, d)).select("id", "grade_numeric", "sub_grade_numeric")


@query("g3_threshold_flags", Q.build(["loans_raw"], """
SELECT id, CAST(coalesce(delinq_2yrs > 0, false) AS INTEGER) AS delinq_ever, CAST(coalesce(revol_util > 75, false) AS INTEGER) AS high_utilization,
  CAST(coalesce(mort_acc > 0, false) AS INTEGER) AS has_mortgage, CAST(coalesce(pub_rec_bankruptcies > 0, false) AS INTEGER) AS has_bankruptcy FROM loans_raw"""))
def flags(spark, d):
    return G.threshold_flags(V.loans_raw(spark, d)).select("id", "delinq_ever", "high_utilization", "has_mortgage", "has_bankruptcy")


@query("g4_home_groups", Q.build(["loans_raw"], """
SELECT id, CASE WHEN home_ownership IN ('RENT', 'OWN', 'MORTGAGE') THEN home_ownership ELSE 'OTHER' END AS home FROM loans_raw"""))
def homes(spark, d):
    return V.loans_raw(spark, d).select("id", G.home_group(F.col("home_ownership")).alias("home"))


@query("g5_fit_categories", Q.build(["categories"], 'SELECT "column", category, code FROM categories'))
def categories(spark, d):
    return V.categories(spark, d)


@query("g6_encode_categories", Q.build(["loans_raw", "categories"], """
SELECT id, coalesce(cp.code, -1) AS purpose, coalesce(cv.code, -1) AS verification_status, coalesce(ch.code, -1) AS home_ownership
FROM loans_raw l LEFT JOIN categories cp ON cp."column" = 'purpose' AND cp.category = l.purpose
LEFT JOIN categories cv ON cv."column" = 'verification_status' AND cv.category = l.verification_status
LEFT JOIN categories ch ON ch."column" = 'home_ownership' AND ch.category = l.home_ownership"""))
def encode(spark, d):
    # ANY was never seen by the fit, so it must turn to -1
    rows = V.loans_raw(spark, d).select("id", "purpose", "verification_status", "home_ownership")
    return G.encode_categories(rows, V.categories(spark, d))


@query("g7_decode_categories", Q.build(["gold", "categories"], """
SELECT id, c.category AS home_label, CASE CAST(emp_length_missing AS INTEGER) WHEN 0 THEN 'Reported' WHEN 1 THEN 'Not Reported' END AS length_label
FROM gold g LEFT JOIN categories c ON c."column" = 'home_ownership' AND c.code = CAST(g.home_ownership AS INTEGER)"""))
def decode(spark, d):
    rows = V.gold(spark, d).select(
        "id", F.col("home_ownership").cast("int").alias("home_ownership"), F.col("emp_length_missing").cast("int").alias("emp_length_missing"))
    named = G.decode_categories(rows, "home_ownership", V.categories(spark, d), {}, "home_label")
    named = G.decode_categories(named, "emp_length_missing", None, PROTECTED_ATTRIBUTES["emp_length_missing"][0], "length_label")
    return named.select("id", "home_label", "length_label")


@query("g8_time_split", Q.build(["silver"], f"""
SELECT id, CASE WHEN issue_d < DATE '{V.TRAIN_END}' THEN 'train' WHEN issue_d < DATE '{V.VALIDATION_END}' THEN 'val' ELSE 'test' END AS split FROM silver"""))
def split(spark, d):
    return G.time_split(V.silver(spark, d), "issue_d", V.TRAIN_END, V.VALIDATION_END).select("id", "split")


@query("g9_gold_features", Q.build(["gold"], 'SELECT id, "default", split, ' + ", ".join(f"{r(f)} AS {f}" for f in FEATURES) + " FROM gold"))
def gold_features(spark, d):
    return rounded(V.fresh_gold(spark, d).select("id", "default", "split", *FEATURES))


# ---------------------------------------------------------------- quality

def checks_sql(rows: list[tuple[str, str, str]], source: str, deps: list[str], where: str = "") -> str:
    return Q.build(deps, " UNION ALL ".join(
        f"SELECT '{name}' AS expectation, coalesce({ok}, false) AS success, CAST({seen} AS VARCHAR) AS observed FROM {source} {where}"
        for name, ok, seen in rows))


def none_fail(name: str, condition: str) -> tuple[str, str, str]:
    failed = f"count(*) FILTER (WHERE NOT coalesce({condition}, false))"
    return name, f"{failed} = 0", failed


RATE = ("default_rate_between_5_50_pct", 'avg("default") BETWEEN 0.05 AND 0.5', 'round(avg("default"), 4)')


@query("d1_bronze_checks", checks_sql([
    ("row_count_gt_zero", "count(*) > 0", "count(*)"),
    ("ingested_at_not_null", "count(*) > 0", "0"),
    ("source_file_exists", "min(false)", "max('column missing')"),
], "loans_raw", ["loans_raw"]))
def bronze_checks(spark, d):
    return D.bronze_checks(V.loans_raw(spark, d).withColumn("ingested_at", V.now()))


@query("d2_silver_checks", checks_sql([
    ("row_count_gt_zero", "count(*) > 0", "count(*)"),
    ("loan_amnt_not_null", "count(*) > 0 AND count(loan_amnt) = count(*)", "count(*) - count(loan_amnt)"),
    ("int_rate_not_null", "count(*) > 0 AND count(int_rate) = count(*)", "count(*) - count(int_rate)"),
    ("fico_score_not_null", "count(*) > 0 AND count(fico_score) = count(*)", "count(*) - count(fico_score)"),
    none_fail("fico_score_between_300_850", "fico_score BETWEEN 300 AND 850"),
    none_fail("annual_inc_non_negative", "annual_inc >= 0"),
    none_fail("dti_between_0_100", "dti BETWEEN 0 AND 100"),
    none_fail("default_is_binary", '"default" IS NULL OR "default" IN (0, 1)'),
    RATE,
], "cleaned", ["cleaned"]))
def silver_checks(spark, d):
    # before the fills and the range gate, so that a check fails
    return D.silver_checks(V.cleaned(spark, d))


@query("d3_gold_checks", checks_sql([
    ("row_count_gt_1000", "count(*) > 1000", "count(*)"),
    ("all_feature_columns_present", "count(*) >= 0", "max('all present')"),
    none_fail("grade_numeric_between_1_7", "grade_numeric IS NULL OR grade_numeric BETWEEN 1 AND 7"),
    none_fail("sub_grade_numeric_between_1_35", "sub_grade_numeric IS NULL OR sub_grade_numeric BETWEEN 1 AND 35"),
    *[none_fail(f"{c}_is_binary", f"{c} IS NULL OR {c} IN (0, 1)") for c in BINARY_COLUMNS],
    RATE,
], "gold", ["gold"], "WHERE split = 'test'"))
def gold_checks(spark, d):
    return D.gold_checks(V.gold(spark, d).where("split = 'test'"))


LOOSE = ["loan_amnt", "dti", "revol_util", "mths_since_last_delinq", "emp_length", "mort_acc"]


@query("d4_null_fraction_gate", Q.build(["loans_raw"], "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'avg(CAST({c} IS NULL AS INTEGER))')} AS null_fraction FROM loans_raw" for c in LOOSE) + ") WHERE null_fraction > 0.05"))
def null_gate(spark, d):
    return rounded(D.too_many_nulls(V.loans_raw(spark, d), columns=LOOSE))


@query("d5_gated_write", Q.build(["silver"], 'SELECT id, "default" FROM silver'))
def gated_write(spark, d):
    rows = V.silver(spark, d)
    refused = scratch_path(spark, "refused")
    try:
        layers.write_checked(V.cleaned(spark, d), refused, D.silver_checks, "silver", strict=True)
        raise AssertionError("a strict gate let a bad layer through")
    except D.QualityError:
        if layers.is_complete(spark, refused):
            raise AssertionError("a refused layer was written")
    path = scratch_path(spark, "gated")
    layers.write_checked(rows, path, D.silver_checks, "silver", strict=True)
    return spark.read.parquet(path).select("id", "default")


@query("d7_value_report", Q.build(["gold_wide", "loans_raw"], " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) - count({x}) AS null_count, {r(f'(count(*) - count({x})) / count(*)::DOUBLE')} AS null_rate,
  count(*) FILTER (WHERE isinf({x})) AS inf_count FROM loans_raw"""
    for c, x in [(c, c) for c in ("dti", "revol_util", "mort_acc", "delinq_2yrs", "annual_inc")]
    + [("log_open", "CASE WHEN inq_last_6mths = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(inq_last_6mths) END")])))
def value_report(spark, d):
    rows = V.loans_raw(spark, d).withColumn(
        "log_open", F.when(F.col("inq_last_6mths") == 0, F.lit(float("-inf"))).otherwise(F.log("inq_last_6mths")))
    return rounded(D.value_report(rows, ["dti", "revol_util", "mort_acc", "delinq_2yrs", "annual_inc", "log_open"]))
