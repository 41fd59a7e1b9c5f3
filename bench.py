"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every query is run once to warm the session and then timed to
the last row of its result; the stored layers are built before the clock starts.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import functions as F

from checks import views
from checks.catalog import QUERIES
from riskframe.functions.scorecard import calibrated
from riskframe.operators.trees import Ensemble, Node, load_ensemble, node_covers, with_attributions, with_probability
from riskframe.session import local_session

HEADLINE = [
    "p10_median_fill", "g9_gold_features", "d3_gold_checks", "a2_exact_quantiles", "a4_psi", "a6_csi", "a8_roc_auc",
    "a9_ks", "a11_metrics_per_split", "a12_score_deciles", "a14_gains_table", "a18_reliability_table", "a24_fairness_report",
    "a29_describe", "s4_upsert_snapshots", "j1_backfill_outcomes", "j3_lookup_exact_version", "t5_adverse_actions",
    "m5_batch_score", "m5_batch_score_vectorised", "m7_attributions", "m14_score_requests", "m16_compare_models",
    "m20_drift_verdict", "m21_performance_verdict", "r1_retention_report", "st1_decisions_tumbling", "flagship_scored_cohorts",
]


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    layers = seconds(lambda: views.gold(spark, d).count())

    timed = {}
    for name in HEADLINE:
        drain(QUERIES[name](spark, d))
        timed[name] = seconds(lambda: drain(QUERIES[name](spark, d)))

    # throughput per row on the line items, as model inputs
    rows = views.table(spark, d, "lineitem").selectExpr(
        "l_extendedprice / 100000 as loan_to_income", "l_quantity * 2 as dti", "600 + l_orderkey % 250 as fico_score"
    )
    n = rows.count()
    model = load_ensemble(node_covers(rows, views.tree_nodes(spark)), views.BASELINE)
    scoring = seconds(lambda: drain(with_probability(rows, model).withColumn("pd", calibrated_score())))
    explaining = seconds(lambda: drain(with_attributions(rows, model)))
    forest = large_model()
    parts = int(cpus) if cpus.isdigit() else 8
    wide = rows.select(*[(F.col("dti") * (1 + i % 7) + F.col("fico_score") * (i % 5) / 100 + F.col("loan_to_income") * i).alias(f) for i, f in enumerate(forest.features)])
    wide = wide.repartition(parts).persist()
    wide.count()
    few = wide.limit(20_000).repartition(parts).persist()
    few.count()
    large_scoring = seconds(lambda: drain(with_probability(wide, forest)))
    large_explaining = seconds(lambda: drain(with_attributions(few, forest)))
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed,
        "sf": d.rstrip("/").rsplit("sf", 1)[-1], "layer_build_sec": layers,
        "rows": n, "scored_rows_per_sec": round(n / scoring), "explained_rows_per_sec": round(n / explaining),
        "scored_rows_per_sec_940_trees": round(n / large_scoring), "explained_rows_per_sec_940_trees": round(20_000 / large_explaining),
    }))
    spark.stop()


def large_model(trees: int = 940, depth: int = 6, features: int = 33) -> Ensemble:
    """A model of the size that is used in practice: full trees over 33 features, 255 thresholds each."""
    rng = np.random.default_rng(1)
    inner, leaves = 2 ** depth - 1, 2 ** depth

    def tree():
        nodes = {}
        for i in range(inner):
            nodes[i] = Node(f"f{rng.integers(features):02}", float(rng.integers(1, 256)), bool(rng.random() < 0.5), 2 * i + 1, 2 * i + 2, None, float(leaves >> (i + 1).bit_length() - 1))
        for i in range(inner, inner + leaves):
            nodes[i] = Node(None, None, None, None, None, float(rng.normal() / 50), 1.0)
        return nodes

    return Ensemble([tree() for _ in range(trees)], 0.0)


def calibrated_score():
    from pyspark.sql import functions as F

    return calibrated(F.col("score"), *views.CALIBRATOR)


if __name__ == "__main__":
    main()
