"""Credit views built from the supplied star-schema tables with the DataFrame API.

``sql.py`` holds the same views as SQL. All keys are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.functions.tables import FEATURES
from riskframe.operators.gold import fit_categories, gold_features, home_group, income_ratios, time_split
from riskframe.operators.silver import cleaned_loans, silver_loans
from riskframe.operators.trees import NODE_SCHEMA, load_ensemble, with_probability
from riskframe.functions.scorecard import calibrated, decision
from riskframe.session import scratch_path
from riskframe.sources.feature_store import snapshots
from riskframe.sources.layers import write_once

TRAIN_END = "1999-01-01"
VALIDATION_END = "2000-07-01"
NOW = "2024-02-15 00:00:00"
MODEL_VERSION = "v1.1"

BASELINE = -1.0
# tree, node, leaf, feature, threshold, missing left, left, right, value
TREES = [
    (0, 0, False, "fico_score", 700.0, True, 1, 4, None),
    (0, 1, False, "dti", 40.0, True, 2, 3, None),
    (0, 2, True, None, None, None, None, None, -0.2),
    (0, 3, True, None, None, None, None, None, 0.6),
    (0, 4, True, None, None, None, None, None, -0.9),
    (1, 0, False, "loan_to_income", 0.35, True, 1, 2, None),
    (1, 1, True, None, None, None, None, None, -0.5),
    (1, 2, False, "fico_score", 680.0, False, 3, 4, None),
    (1, 3, True, None, None, None, None, None, 0.8),
    (1, 4, True, None, None, None, None, None, 0.1),
    (2, 0, False, "dti", 60.0, False, 1, 4, None),
    (2, 1, False, "dti", 20.0, False, 2, 3, None),
    (2, 2, True, None, None, None, None, None, -0.4),
    (2, 3, True, None, None, None, None, None, 0.05),
    (2, 4, False, "loan_to_income", 0.2, False, 5, 6, None),
    (2, 5, True, None, None, None, None, None, 0.3),
    (2, 6, True, None, None, None, None, None, 0.7),
]
CALIBRATOR = ([0.05, 0.1, 0.2, 0.4, 0.8], [0.02, 0.08, 0.18, 0.35, 0.7])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def tree_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, None) for row in TREES], NODE_SCHEMA)


def ensemble(spark: SparkSession, trees: int = 3):
    return load_ensemble(tree_nodes(spark).where(F.col("tree_id") < trees), BASELINE)


def _employment(k: Column) -> Column:
    r = k % 13
    return (
        F.when(r == 0, "n/a").when(r == 1, "< 1 year").when(r == 2, "1 year")
        .when(r == 11, "10+ years").when(r == 12, None)
        .otherwise(F.concat((r - 1).cast("string"), F.lit(" years")))
    )


def loans_view(spark: SparkSession, d: str) -> DataFrame:
    """Accepted loans as raw text and numbers, one per order."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    date = F.to_date("o_orderdate")

    def missing(every: int, value: Column) -> Column:
        return F.when(k % every != 0, value.cast("double"))

    home = (
        F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE"), "MORTGAGE")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "RENT")
        .when(F.col("c_mktsegment") == "BUILDING", "OWN")
        .otherwise("ANY")
    )
    priority = F.substring("o_orderpriority", 1, 1)
    letter = F.substring(F.lit("ABCDEFG"), (k % 7 + 1).cast("int"), F.lit(1))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("id"),
        F.date_format(date, "MMM-yyyy").alias("issue_d"),
        F.date_format(F.add_months(date, (-(24 + k % 300)).cast("int")), "MMM-yyyy").alias("earliest_cr_line"),
        (price / 10).alias("loan_amnt"),
        (price / 10 * F.lit(0.033)).alias("installment"),
        F.when(k % 3 == 0, " 60 months").otherwise(" 36 months").alias("term"),
        F.concat(
            (5 + k % 24).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("%")
        ).alias("int_rate"),
        letter.alias("grade"),
        F.concat(letter, (k % 5 + 1).cast("string")).alias("sub_grade"),
        _employment(k).alias("emp_length"),
        home.alias("home_ownership"),
        ((F.col("c_acctbal") + 1000) * 12).alias("annual_inc"),
        F.when(priority.isin("1", "2"), "Verified").when(priority == "3", "Source Verified")
        .otherwise("Not Verified").alias("verification_status"),
        F.lower("c_mktsegment").alias("purpose"),
        missing(53, k % 108).alias("dti"),
        missing(61, F.floor((k % 4) / 2)).alias("delinq_2yrs"),
        missing(47, F.floor((k % 5) / 2)).alias("mort_acc"),
        missing(59, k % 121).alias("revol_util"),
        F.when(k % 2 != 0, (k % 90).cast("double")).alias("mths_since_last_delinq"),
        (k % 4).cast("double").alias("inq_last_6mths"),
        (2 + k % 28).cast("double").alias("open_acc"),
        F.floor((k % 10) / 9).cast("double").alias("pub_rec"),
        (4 + k % 56).cast("double").alias("total_acc"),
        F.floor((k % 12) / 11).cast("double").alias("pub_rec_bankruptcies"),
        (price / 20).alias("revol_bal"),
        (620 + k % 230).cast("double").alias("fico_range_low"),
        (624 + k % 230).cast("double").alias("fico_range_high"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 2 == 0), "Charged Off")
        .when(F.col("o_orderstatus").isin("F", "O"), "Fully Paid")
        .otherwise("Current").alias("loan_status"),
    )


def rejected_view(spark: SparkSession, d: str) -> DataFrame:
    """Rejected applications, one per order that is still pending."""
    k = F.col("o_orderkey")
    return (
        table(spark, d, "orders").where("o_orderstatus = 'P'")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("id"),
            (F.col("o_totalprice") / 10).alias("Amount Requested"),
            F.when(k % 71 != 0, (550 + k % 200).cast("double")).alias("Risk_Score"),
            F.concat((k % 90).cast("string"), F.lit("%")).alias("Debt-To-Income Ratio"),
            _employment(k).alias("Employment Length"),
            F.to_date("o_orderdate").alias("Application Date"),
            F.col("n_name").alias("State"),
        )
    )


_LAYERS: dict[tuple[str, str, str], str] = {}


def layer(spark, d: str, name: str, build) -> DataFrame:
    """A layer written once per application to the shared folder and read from there.

    Consumers of silver and gold read the stored layer, as in a medallion
    pipeline; the queries about building a layer do not use this.
    """
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _LAYERS:
        path = scratch_path(spark, f"layer-{name}")
        write_once(build(spark, d), path)
        _LAYERS[key] = path
    return spark.read.parquet(_LAYERS[key])


def _spread(df: DataFrame) -> DataFrame:
    """Ingested rows over the shuffle width, as after an unsplittable raw file."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def loans_raw(spark, d) -> DataFrame:
    """The bronze layer of accepted loans."""
    return layer(spark, d, "bronze-accepted", lambda spark, d: _spread(loans_view(spark, d)))


def rejected_raw(spark, d) -> DataFrame:
    """The bronze layer of rejected applications."""
    return layer(spark, d, "bronze-rejected", lambda spark, d: _spread(rejected_view(spark, d)))


def cleaned(spark, d) -> DataFrame:
    return cleaned_loans(loans_raw(spark, d))


def fresh_silver(spark, d) -> DataFrame:
    return silver_loans(loans_raw(spark, d))


def silver(spark, d) -> DataFrame:
    return layer(spark, d, "silver", fresh_silver)


def categories(spark, d) -> DataFrame:
    rows = silver(spark, d)
    return fit_categories(rows.withColumn("home_ownership", home_group(F.col("home_ownership"))))


def fresh_gold(spark, d) -> DataFrame:
    return time_split(gold_features(fresh_silver(spark, d)), "issue_d", TRAIN_END, VALIDATION_END)


def gold(spark, d) -> DataFrame:
    return layer(
        spark, d, "gold",
        lambda spark, d: time_split(gold_features(silver(spark, d)), "issue_d", TRAIN_END, VALIDATION_END),
    )


def model_input(spark, d) -> DataFrame:
    """Model inputs before imputation: dti is missing for some loans."""
    rows = income_ratios(cleaned(spark, d))
    return rows.select("id", "issue_d", "default", "loan_to_income", "dti", F.col("fico_score").cast("double").alias("fico_score"))


def scored_gold(spark, d) -> DataFrame:
    """Gold rows with the model score, the calibrated probability and a second model's score."""
    rows = with_probability(gold(spark, d), ensemble(spark), "score")
    rows = with_probability(rows, ensemble(spark, 2), "score_b")
    return rows.withColumns(
        {
            "pd": calibrated(F.col("score"), *CALIBRATOR),
            "pd_b": calibrated(F.col("score_b"), *CALIBRATOR),
        }
    )


def scored_lines(spark, d) -> DataFrame:
    """Line items as scored rows: p has few ties, q fifty values."""
    return table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_extendedprice") / 1e5).alias("p"),
        (F.col("l_quantity") / 50).alias("q"),
        "l_orderkey", "l_linestatus", "l_shipdate",
    )


def scoring_log(spark, d) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    known = F.col("event_type").isin("error", "purchase")
    score = F.least(F.col("value") / 500, F.lit(1.0))
    return table(spark, d, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("LC_"), F.col("user_id").cast("string")).alias("applicant_id"),
        ts.alias("scored_at"),
        F.concat(F.lit("v1."), (F.col("event_id") % 3).cast("string")).alias("model_version"),
        score.alias("score"),
        F.create_map(
            F.lit("k"), F.get_json_object("props", "$.k").cast("double"), F.lit("value"), F.col("value")
        ).alias("feature_snapshot"),
        decision(score).alias("decision"),
        F.when(known, F.col("event_type") == "error").alias("actual_default"),
        F.when(known, ts + F.make_dt_interval(F.lit(7))).alias("outcome_observed_at"),
    )


def outcomes(spark, d) -> DataFrame:
    """Loan outcomes of the customers outside one segment."""
    return (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .where("c_mktsegment <> 'MACHINERY'")
        .groupBy(F.col("o_custkey").alias("id"))
        .agg((2 * F.count_if(F.col("o_orderstatus") == "F") > F.count(F.lit(1))).alias("label"))
    )


def drift_log(spark, d) -> DataFrame:
    """One metric row per event type and day, with the day's means as details."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).alias("measured_at")
    mean = table(spark, d, "events").groupBy(day, F.col("event_type").alias("metric_name")).agg(
        F.round(F.avg("value"), 5).alias("metric_value"),
        F.concat(F.lit("v1."), (F.max("event_id") % 3).cast("string")).alias("model_version"),
    )
    details = mean.groupBy("measured_at").agg(
        F.to_json(
            F.struct(F.map_from_entries(F.collect_list(F.struct("metric_name", "metric_value"))).alias("csi"))
        ).alias("details")
    )
    return mean.join(details, "measured_at")


def feature_store(spark, d) -> DataFrame:
    """Test rows at version 1, validation rows at version 1 without dti, training rows at version 2."""
    rows = gold(spark, d)
    at = now() - F.make_dt_interval((F.col("id") % 40).cast("int"))
    full, short = list(FEATURES), [f for f in FEATURES if f != "dti"]
    return (
        snapshots(rows.where("split = 'test'"), full, 1, at)
        .unionByName(snapshots(rows.where("split = 'val'"), short, 1, at))
        .unionByName(snapshots(rows.where("split = 'train'"), full, 2, at))
    )


def requests(spark, d) -> DataFrame:
    """One request per order, and one per customer under an id that is not allowed."""
    orders = table(spark, d, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("request_id"),
        F.concat(F.lit("LC_"), F.col("o_orderkey").cast("string")).alias("applicant_id"),
    )
    customers = table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("request_id"),
        F.col("c_name").alias("applicant_id"),
    )
    return orders.unionByName(customers)


def heap_nodes(spark, d) -> DataFrame:
    """A node table that grows with the orders: each customer's orders as a heap-shaped tree.

    Some split nodes have no children or an unknown feature, so the checks
    have something to find.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").cast("int").alias("tree_id"),
        (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("node_id"),
        F.count(F.lit(1)).over(w).alias("n"),
        "o_orderkey", "o_orderstatus", "o_totalprice",
    )
    left, right = 2 * F.col("node_id") + 1, 2 * F.col("node_id") + 2
    leaf = (F.col("o_orderstatus") == "F") & (right >= F.col("n"))
    names = F.array(*[F.lit(f) for f in FEATURES])
    return rows.select(
        "tree_id", "node_id", leaf.alias("is_leaf"),
        F.get(names, (F.col("o_orderkey") % 35).cast("int")).alias("feature"),
        (F.col("o_totalprice") / 1000).alias("threshold"), F.lit(True).alias("missing_left"),
        left.cast("int").alias("left"), right.cast("int").alias("right"),
        F.lit(0.1).alias("value"), F.lit(1.0).alias("cover"),
    )
