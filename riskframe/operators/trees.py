"""Tree ensembles as a node table: checks, scoring, attributions and reasons.

Scoring and attribution touch each row once and never shuffle. A small
ensemble becomes generated column expressions; a large one is evaluated by a
vectorised Arrow function over node arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from riskframe.contract import DEFAULT, Contract
from riskframe.functions.literals import sql_double
from riskframe.functions.parsing import clean
from riskframe.functions.tables import REASONS
from riskframe.operators.bitscore import TREES_PER_BLOCK, Attributions, Leaves, Scorer, shapley_table

NODE_SCHEMA = (
    "tree_id int, node_id int, is_leaf boolean, feature string, threshold double, "
    "missing_left boolean, left int, right int, value double, cover double"
)
MAX_NODES = 5_000_000
MAX_EXPRESSION_LEAVES = 400  # the size of generated code; above it the Arrow form, with the same results
MAX_EXPRESSION_PATH = 8


# ---------------------------------------------------------------- node table

def invalid_nodes(nodes: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(tree_id, node_id, problem) of split nodes that could not be walked.

    A child must come after its parent and exist in the tree; the feature must
    be known. Trees are compared with their own size, so one aggregation and an
    equi join suffice.
    """
    sizes = nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("feature").isNotNull()
    if features is not None:
        known = known & F.col("feature").isin(*features)
    bad_child = (
        (F.col("left") <= F.col("node_id")) | (F.col("right") <= F.col("node_id"))
        | (F.col("left") >= F.col("n")) | (F.col("right") >= F.col("n"))
        | F.col("left").isNull() | F.col("right").isNull()
    )
    return (
        nodes.where(~F.col("is_leaf"))
        .join(sizes, "tree_id")
        .select(
            "tree_id",
            "node_id",
            F.when(bad_child, "child").when(~known, "feature").alias("problem"),
        )
        .where("problem is not null")
    )


def expected_value(nodes: DataFrame, baseline: float = 0.0) -> DataFrame:
    """Baseline plus the cover-weighted mean leaf of every tree."""
    root = F.max(F.when(F.col("node_id") == 0, F.col("cover")))
    leaves = F.sum(F.when(F.col("is_leaf"), F.col("value") * F.col("cover")))
    per_tree = nodes.groupBy("tree_id").agg((leaves / root).alias("mean_leaf"))
    return per_tree.agg((F.sum("mean_leaf") + F.lit(float(baseline))).alias("expected_value"))


@dataclass
class Node:
    feature: str | None
    threshold: float | None
    missing_left: bool | None
    left: int | None
    right: int | None
    value: float | None
    cover: float | None

    @property
    def is_leaf(self) -> bool:
        return self.feature is None


@dataclass
class Ensemble:
    """A model small enough to be shipped with every task."""

    trees: list[dict[int, Node]]
    baseline: float = 0.0

    @property
    def features(self) -> list[str]:
        found = {n.feature for t in self.trees for n in t.values() if not n.is_leaf}
        return sorted(found)

    @property
    def leaf_count(self) -> int:
        return sum(n.is_leaf for t in self.trees for n in t.values())


def load_ensemble(nodes: DataFrame, baseline: float = 0.0, max_nodes: int = MAX_NODES) -> Ensemble:
    """Read a node table of bounded size into memory."""
    rows = nodes.limit(max_nodes + 1).collect()
    if not rows or len(rows) > max_nodes:
        raise ValueError(f"an ensemble needs 1..{max_nodes} nodes")
    trees: dict[int, dict[int, Node]] = {}
    for r in rows:
        leaf = r["is_leaf"]
        trees.setdefault(r["tree_id"], {})[r["node_id"]] = Node(
            None if leaf else r["feature"], r["threshold"], r["missing_left"],
            r["left"], r["right"], r["value"], r["cover"],
        )
    return Ensemble([trees[t] for t in sorted(trees)], baseline)


# ---------------------------------------------------------------- scoring

CLEANED = "__clean_"


def _goes_left(node: Node, cleaned: bool = False) -> str:
    """NaN counts as missing; Spark itself would order it above all numbers. ``cleaned`` reads a column without NaN."""
    value = f"`{CLEANED}{node.feature}`" if cleaned else f"nullif(double(`{node.feature}`), double('NaN'))"
    test = f"{value} <= {sql_double(node.threshold)}"
    return f"coalesce({test}, {'true' if node.missing_left else 'false'})"


def _tree_sql(tree: dict[int, Node], at: int = 0) -> str:
    node = tree[at]
    if node.is_leaf:
        return sql_double(node.value)
    return (
        f"case when {_goes_left(node)} then {_tree_sql(tree, node.left)} "
        f"else {_tree_sql(tree, node.right)} end"
    )


def raw_score_expression(ensemble: Ensemble) -> Column:
    """Log-odds as generated code: one nested CASE per tree."""
    terms = [sql_double(ensemble.baseline)] + [f"({_tree_sql(t)})" for t in ensemble.trees]
    return F.expr(" + ".join(terms))


def _matrix(features: list[str]) -> Column:
    """The model's inputs as one struct; NaN is missing here as everywhere."""
    return F.struct(*[clean(F.col(f)).alias(f) for f in features])


def _numbers(rows: pd.DataFrame) -> np.ndarray:
    return rows.to_numpy(dtype=float, na_value=np.nan)


def raw_score_vectorised(spark, ensemble: Ensemble) -> Column:
    """Log-odds by an Arrow function over the bit masks of all trees."""
    features = ensemble.features
    shipped = spark.sparkContext.broadcast(Scorer(ensemble.trees, features, ensemble.baseline))

    @F.pandas_udf(T.DoubleType())
    def score(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(shipped.value.raw(_numbers(rows)))

    return score(_matrix(features)) if features else F.lit(float(ensemble.baseline + sum(t[0].value for t in ensemble.trees)))


def with_donors(ensemble: Ensemble, used: list[str]) -> Column:
    """Log-odds of a row as it is, then with each used feature taken from ``donor_<feature>``."""
    features = ensemble.features
    order = [1 + features.index(f) for f in used]
    spark = SparkSession.getActiveSession()
    shipped = spark.sparkContext.broadcast(Scorer(ensemble.trees, features, ensemble.baseline))
    n = len(features)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(rows: pd.DataFrame) -> pd.Series:
        x = _numbers(rows)
        return pd.Series(list(shipped.value.raw_with_donors(x[:, :n], x[:, n:])[:, [0, *order]]))

    donors = [clean(F.col(f"donor_{f}")).alias(f"donor_{f}") if f in used else clean(F.col(f)).alias(f"donor_{f}") for f in features]
    return score(F.struct(*[clean(F.col(f)).alias(f) for f in features], *donors))


def with_raw_score(df: DataFrame, ensemble: Ensemble, name: str = "raw_score") -> DataFrame:
    """Both forms give the same score on every input; few leaves are cheaper as generated code."""
    if ensemble.leaf_count <= MAX_EXPRESSION_LEAVES:
        return df.withColumn(name, raw_score_expression(ensemble))
    return df.withColumn(name, raw_score_vectorised(df.sparkSession, ensemble))


def with_probability(df: DataFrame, ensemble: Ensemble, name: str = "score") -> DataFrame:
    """Probability of default of every row."""
    scored = with_raw_score(df, ensemble, "__raw")
    return scored.withColumn(name, 1 / (1 + F.exp(-F.col("__raw")))).drop("__raw")


def node_covers(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node table with ``cover`` = rows of ``df`` that reach each node.

    Every task counts the leaves of its rows, whatever the number of trees, and
    emits one row per (tree, leaf); inner nodes add up the leaves below them.
    """
    ensemble = load_ensemble(nodes)
    features = ensemble.features
    shipped = df.sparkSession.sparkContext.broadcast(Leaves(ensemble.trees, features))

    def count(batches):
        leaves, hits = shipped.value, {}
        for batch in batches:
            x = _numbers(batch[features]) if features else np.zeros((len(batch), 0))
            for _, n, (_, _, ids, base), found in leaves.tiles(x) if features else ():
                flat = np.bincount((found + base).ravel(), minlength=ids.size)
                hits[n] = hits.get(n, 0) + flat
            if not features:
                hits[0] = hits.get(0, 0) + len(batch)
        for n, flat in hits.items():
            if not features:
                trees = range(len(ensemble.trees))
                yield pd.DataFrame({"tree": list(trees), "leaf": 0, "hits": float(flat)})
                continue
            ids = leaves.blocks[n][2]
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"tree": n * TREES_PER_BLOCK + at // ids.shape[1], "leaf": ids.ravel()[at], "hits": flat[at].astype(float)})

    inputs = df.select(*[clean(F.col(f)).alias(f) for f in features]) if features else df.select(F.lit(1).alias("one"))
    hits = (
        inputs.mapInPandas(count, "tree int, leaf int, hits double").groupBy("tree", "leaf").agg(F.sum("hits").alias("hits"))
    )
    ids = sorted({r["tree_id"] for r in nodes.select("tree_id").distinct().collect()})
    below = []
    for number, tree in enumerate(ensemble.trees):
        for i in tree:
            stack, leaves = [i], []
            while stack:
                at = stack.pop()
                if tree[at].is_leaf:
                    leaves.append(at)
                else:
                    stack += [tree[at].left, tree[at].right]
            below += [(ids[number], i, number, leaf) for leaf in leaves]
    spark = df.sparkSession
    reach = spark.createDataFrame(below, "tree_id int, node_id int, tree int, leaf int")
    covers = (
        reach.join(F.broadcast(hits), ["tree", "leaf"], "left")  # one row per leaf of the model
        .groupBy("tree_id", "node_id")
        .agg(F.coalesce(F.sum("hits"), F.lit(0.0)).alias("cover"))
    )
    return nodes.drop("cover").join(covers, ["tree_id", "node_id"])


# ---------------------------------------------------------------- attributions

@dataclass
class Leaf:
    """A leaf by the distinct features on its path.

    ``tests[k]`` are the split tests on feature k as (node, must go left);
    ``share[k]`` is the product of cover fractions of those splits.
    """

    features: list[str]
    tests: list[list[tuple[Node, bool]]]
    share: list[float]
    value: float


def _leaves(tree: dict[int, Node]) -> list[Leaf]:
    found = []

    def walk(at: int, path: list[tuple[Node, bool, float]]):
        node = tree[at]
        if node.is_leaf:
            order: dict[str, tuple[list, float]] = {}
            for split, left, fraction in path:
                tests, share = order.get(split.feature, ([], 1.0))
                order[split.feature] = (tests + [(split, left)], share * fraction)
            found.append(
                Leaf(
                    list(order), [t for t, _ in order.values()], [s for _, s in order.values()], node.value
                )
            )
            return
        for left, child in ((True, node.left), (False, node.right)):
            fraction = tree[child].cover / node.cover if node.cover else 0.0
            walk(child, path + [(node, left, fraction)])

    walk(0, [])
    return found


def attribution_expressions(ensemble: Ensemble) -> dict[str, Column]:
    """Contribution of each used feature to the log-odds, as generated code over the ``CLEANED`` features: every split
    is tested in several terms, so NaN is taken off once before, which keeps the code small enough to be compiled."""
    terms: dict[str, list[str]] = {f: [] for f in ensemble.features}
    for tree in ensemble.trees:
        for leaf in _leaves(tree):
            if not leaf.features:
                continue
            agree = [
                " and ".join(_goes_left(n, True) if left else f"not {_goes_left(n, True)}" for n, left in tests)
                for tests in leaf.tests
            ]
            mask = " + ".join(f"(int({a}) * {1 << k})" for k, a in enumerate(agree))
            table = shapley_table(np.array([leaf.share]), np.array([leaf.value]))[0]
            for k, feature in enumerate(leaf.features):
                values = ", ".join(sql_double(v) for v in table[:, k])
                terms[feature].append(f"get(array({values}), {mask})")
    return {f: F.expr(" + ".join(t)) for f, t in terms.items() if t}


def attributions_vectorised(spark, ensemble: Ensemble) -> Column:
    """Contributions as an array in the order of ``ensemble.features``."""
    features = ensemble.features
    shipped = spark.sparkContext.broadcast(Attributions(ensemble.trees, features))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explain(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(list(shipped.value.of(_numbers(rows))))

    return explain(_matrix(features))


def with_attributions(df: DataFrame, ensemble: Ensemble, name: str = "contributions") -> DataFrame:
    """Add an array of (feature, contribution, value), one element per used feature.

    The contributions of a row sum to its log-odds minus the expected value.
    """
    features = ensemble.features
    short = all(len(leaf.features) <= MAX_EXPRESSION_PATH for tree in ensemble.trees for leaf in _leaves(tree)) if ensemble.leaf_count <= MAX_EXPRESSION_LEAVES else False
    if short:
        phi = attribution_expressions(ensemble)
        parts = [
            F.struct(
                F.lit(f).alias("feature"),
                phi.get(f, F.lit(0.0)).alias("contribution"),
                F.col(f).cast("double").alias("value"),
            )
            for f in features
        ]
        clean_ = df.withColumns({f"{CLEANED}{f}": clean(F.col(f)) for f in features})
        return clean_.withColumn(name, F.array(*parts)).drop(*[f"{CLEANED}{f}" for f in features])
    explained = df.withColumn("__phi", attributions_vectorised(df.sparkSession, ensemble))
    parts = [
        F.struct(
            F.lit(f).alias("feature"),
            F.get("__phi", F.lit(i)).alias("contribution"),
            F.col(f).cast("double").alias("value"),
        )
        for i, f in enumerate(features)
    ]
    return explained.withColumn(name, F.array(*parts)).drop("__phi")


def global_importance(df: DataFrame, contributions: str = "contributions") -> DataFrame:
    """Mean absolute contribution per feature and its rank."""
    mean = (
        df.select(F.inline(contributions))
        .groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("importance"))
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "feature")
    return mean.withColumn("rank", F.row_number().over(order))  # one row per feature


# ---------------------------------------------------------------- reasons

def reason_table(spark, features: list[str]) -> DataFrame:
    """(feature, code, reason, display); a feature without an entry explains itself."""
    rows = [(f, *REASONS.get(f, (0, f, f))) for f in features]
    return spark.createDataFrame(rows, "feature string, code int, reason string, display string")


def adverse_actions(contributions: str, contract: Contract = DEFAULT) -> Column:
    """Up to four reasons: the largest positive contributions, one per reason code.

    Works inside the row. Ties go to the feature name.
    """
    code = " ".join(f"when '{f}' then {c}" for f, (c, _, _) in REASONS.items())
    reason = " ".join(f"when '{f}' then '{r}'" for f, (_, r, _) in REASONS.items())
    display = " ".join(f"when '{f}' then '{d}'" for f, (_, _, d) in REASONS.items())
    ranked = f"""
        transform(
          array_sort(
            transform(
              filter({contributions}, c -> c.contribution > 0),
              c -> struct(-c.contribution as k, c.feature as feature, c.contribution as contribution,
                          c.value as value, case c.feature {code} else 0 end as code))),
          s -> s)"""
    distinct = f"""
        aggregate(
          {ranked},
          cast(array() as array<struct<k double, feature string, contribution double, value double, code int>>),
          (kept, s) -> case when size(kept) >= {contract.max_reasons} or exists(kept, e -> e.code = s.code)
                            then kept else concat(kept, array(s)) end)"""
    return F.expr(
        f"""transform({distinct}, s -> struct(
              s.code as code,
              case s.feature {reason} else s.feature end as reason,
              case s.feature {display} else s.feature end as feature_name,
              round(s.contribution * 1e5D, 0) / 1e5D as shap_value,
              round(coalesce(s.value, 0) * 1e4D, 0) / 1e4D as feature_value,
              'increases risk' as direction))"""
    )


def with_reasons(
    df: DataFrame, decision: str = "decision", contributions: str = "contributions",
    name: str = "adverse_actions", contract: Contract = DEFAULT,
) -> DataFrame:
    """Reasons for reviews and declines; an empty list for approvals."""
    actions = adverse_actions(contributions, contract)
    return df.withColumn(
        name, F.when(F.col(decision).isin("review", "decline"), actions).otherwise(F.filter(actions, lambda a: F.lit(False)))
    )
