"""Distributed running sums and exact quantiles.

A global order is never built in one task. Rows are first reduced to one per
distinct value (map-side combined), then cut into value ranges whose bounds
come from approximate-quantile sketches of groups of input partitions. A running window inside each range
plus the totals of the lower ranges gives exact running sums. The ranges only
balance the work: any bounds give the same result. The bounds are constants of
the plan, so a lost executor or a re-planned stage cuts the values alike. The
totals hold one row per range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.literals import sql_double, sql_doubles

RANGE = "__range"


ROWS_PER_RANGE = 1_000_000
SKETCH_GROUPS, SKETCH_POINTS = 64, 256


def range_count(df: DataFrame, rows: int) -> int:
    """How many ranges to cut: the shuffle width, more if a range would hold too many rows."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_RANGE)


def range_bounds(df: DataFrame, value: str, n_ranges: int | None = None) -> list[float]:
    """The lowest value of each range of a numeric column but the first.

    Input partitions are sketched in groups, each group by a task of its own;
    what is read is a fixed number of points per group.
    """
    points = [i / SKETCH_POINTS for i in range(1, SKETCH_POINTS)]
    v = F.col(value).cast("double")
    sketched = df.select(v.alias("v"), (F.spark_partition_id() % SKETCH_GROUPS).alias("g")).groupBy("g").agg(
        F.percentile_approx("v", points, 20 * SKETCH_POINTS).alias("b"), F.count("v").alias("n")
    ).where("n > 0").collect()
    count = n_ranges or range_count(df, sum(r["n"] for r in sketched))
    weighted = sorted((x, r["n"]) for r in sketched for x in r["b"])
    step, passed, bounds = sum(n for _, n in weighted) / count, 0, []
    for x, n in weighted:
        passed += n
        if passed >= step * (len(bounds) + 1) and len(bounds) < count - 1:
            bounds += [x] * (int(min(count - 1, passed // step)) - len(bounds))
    return sorted(set(bounds))


def range_index(df: DataFrame, value: str, n_ranges: int | None = None) -> Column:
    """Index of the value range of a numeric column, monotone in the value.

    The bounds are read once and become constants, so every later evaluation
    cuts the values alike. Few bounds are compared one by one in generated code,
    many are searched by halving.
    """
    bounds = range_bounds(df, value, n_ranges)
    if not bounds:
        return F.lit(0)
    v = f"double(`{value}`)"
    if len(bounds) <= 32:
        return F.expr(" + ".join(f"int(coalesce({sql_double(b)} <= {v}, false))" for b in bounds))
    steps = ", ".join(str(1 << i) for i in reversed(range(len(bounds).bit_length())))
    return F.expr(
        f"coalesce(aggregate(array({steps}), 0, (p, s) -> "
        f"if(get({sql_doubles(bounds)}, p + s - 1) <= {v}, p + s, p)), 0)"
    )


def hash_range(df: DataFrame, hashed: str, n_ranges: int | None = None) -> Column:
    """Range index of a 64-bit hash, monotone in the hash; hashes are spread evenly."""
    bits = ((n_ranges or range_count(df, df.count())) - 1).bit_length()
    return F.shiftright(hashed, 64 - bits).cast("int")


def _ranges(df, value, sums, groups, n_ranges, bounds_from, index=None):
    """The frame with its range index, and one row of running totals per range."""
    if index is None:
        index = range_index(df if bounds_from is None else bounds_from, value, n_ranges)
    ranged = df.withColumn(RANGE, index)
    totals = ranged.groupBy(*groups, RANGE).agg(*[F.sum(s).alias(f"__in_{s}") for s in sums])
    by = f"partition by {', '.join(f'`{g}`' for g in groups)}" if groups else ""
    below = f"({by} order by {RANGE} rows between unbounded preceding and 1 preceding)"
    starts = totals.selectExpr(
        *[f"`{g}`" for g in groups],
        RANGE,
        *[f"coalesce(sum(__in_{s}) over {below}, 0) as __start_{s}" for s in sums],
        *[f"sum(__in_{s}) over ({by}) as {s}_total" for s in sums],
        *[f"__in_{s}" for s in sums],
    )
    return ranged, starts


def _running(ranged, starts, value, sums, groups, keep=()):
    inside = (
        Window.partitionBy(*groups, RANGE)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = ranged.join(starts, [*groups, RANGE])
    kept = [c for c in ranged.columns if c != RANGE]
    return joined.select(
        *kept,
        *[
            (F.col(f"__start_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
        *[f"{s}_total" for s in sums],
        *keep,
    )


def running_sums(
    df: DataFrame,
    value: str,
    sums: list[str],
    groups: list[str] = (),
    group_limit: int | None = None,
    n_ranges: int | None = None,
    bounds_from: DataFrame | None = None,
    index: Column | None = None,
) -> DataFrame:
    """Add ``<s>_before`` (sum over lower values) and ``<s>_total`` per group.

    ``df`` has one row per (groups, value); values and group keys are not NULL.
    ``bounds_from`` is a cheaper frame with the same values to balance by, as a
    rule the rows before they were grouped. ``index`` replaces the measured
    ranges by a known monotone function of the value.
    The totals have one row per range and group: they are broadcast when the
    number of groups is known (``group_limit``) and joined by a shuffle if not.
    """
    groups = list(groups)
    ranged, starts = _ranges(df, value, sums, groups, n_ranges, bounds_from, index)
    if not groups or group_limit is not None:
        starts = F.broadcast(starts)
    return _running(ranged, starts, value, sums, groups)


def value_counts(df: DataFrame, value: str, groups: list[str] = ()) -> DataFrame:
    groups = list(groups)
    return (
        df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    groups: list[str] = (),
    weight: str | None = None,
    group_limit: int | None = None,
    n_ranges: int | None = None,
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group as ``quantiles`` (array) and ``n``.

    Only the ranges that hold a wanted rank are ordered. With ``weight`` the
    frame already has one row per (groups, value). ``group_limit`` is the known
    largest number of groups; it bounds the table of wanted ranges, which may
    then be broadcast. Without ``weight`` the rows are then counted per range
    first, and only those of the wanted ranges per value: what a task holds
    follows from the ranges, not from the number of distinct values.
    """
    groups = list(groups)
    by_range = weight is None and (not groups or group_limit is not None)
    if by_range:
        counts, bounds_from = df.where(F.col(value).isNotNull()).withColumn("n", F.lit(1).cast("bigint")), df if bounds_from is None else bounds_from
    elif weight is None:
        counts, bounds_from = value_counts(df, value, groups), df if bounds_from is None else bounds_from
    else:
        counts = df.withColumnRenamed(weight, "n")
    counts = counts.select(*groups, value, "n")
    ranged, starts = _ranges(counts, value, ["n"], groups, n_ranges, bounds_from)

    levels = sql_doubles(probabilities)
    low = "bigint(floor(q * (n_total - 1)))"
    high = f"least({low} + 1, n_total - 1)"
    ranks = f"array_distinct(flatten(transform({levels}, q -> array({low}, {high}))))"
    wanted = starts.withColumn(
        "__ranks", F.expr(f"filter({ranks}, r -> r >= __start_n and r < __start_n + __in_n)")
    ).where("size(__ranks) > 0")
    if not groups or group_limit is not None:
        wanted = F.broadcast(wanted)  # at most ranges x group_limit rows
    if by_range:
        ranged = ranged.join(F.broadcast(wanted.select(*groups, RANGE)), [*groups, RANGE], "left_semi")
        ranged = ranged.groupBy(*groups, RANGE, value).agg(F.sum("n").alias("n"))
    ordered = _running(ranged, wanted, value, ["n"], groups, ["__ranks"])
    # at most two rows per probability and group pass this filter
    held = ordered.where("exists(__ranks, r -> r >= n_before and r < n_before + n)")
    picked = held.groupBy(*groups).agg(
        F.expr(f"collect_list(struct(n_before as a, n_before + n as b, double(`{value}`) as v))").alias("held"),
        F.max("n_total").alias("n_total"),
    )

    def at(rank: str) -> str:
        return f"element_at(filter(held, h -> {rank} >= h.a and {rank} < h.b), 1).v"

    return picked.where("n_total is not null").selectExpr(
        *[f"`{g}`" for g in groups],
        f"""transform({levels}, q -> {at(low)}
            + (q * (n_total - 1) - floor(q * (n_total - 1))) * ({at(high)} - {at(low)})) as quantiles""",
        "n_total as n",
    )


def small_table(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """The frame with a broadcast hint when it has at most ``max_rows`` rows.

    The size is measured, not assumed; a larger frame is returned as it is and
    joined by a shuffle.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
