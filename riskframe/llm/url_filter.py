"""URL rules by a sort-merge range join.

A host becomes a key of its labels in reverse order (``www.example.org`` -> ``org.example.www.``). The subdomains of
a rule's host are then one interval of keys: those that begin with the rule's key. URLs and rules are brought into
one order, cut into ranges, and every range is swept once: a rule's start pushes its scope onto a stack, a key outside
the top scope pops it, and the scopes left on the stack are the active nested rules of a URL. Inside a scope the path
prefixes are nested intervals too, searched from the nearest earlier path along its chain of prefixes.

A scope that spans several ranges is copied to each of them, so any number of rules works and none is broadcast. The
sort key ends in a hash of the id: one host or one URL with a third of the rows is cut into many ranges.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE_PER_RANGE = 100
LAST = "\U0010ffff"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Both empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Scope:
    """The path rules of one host, in order, each with the nearest earlier path that is its prefix."""

    def __init__(self, key: str):
        self.key, self.paths, self.rules, self.parents = key, [], [], []

    def add(self, path: str, rule: tuple[str, str, int]) -> None:
        if self.paths and self.paths[-1] == path:
            if rule[1] == "block":  # of two equal rules the stricter counts
                self.rules[-1] = rule
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.parents[at]
        self.paths.append(path)
        self.rules.append(rule)
        self.parents.append(at)

    def longest(self, path: str) -> tuple[str, str, int] | None:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.parents[at]
        return self.rules[at] if at >= 0 else None


def sweep(default: str):
    """One pass over sorted rows (range, sort key, is_url): rules open scopes, URLs read the stack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Scope] = []
        current = None
        for batch in batches:
            names = ["range_", "key", "is_url", "path", "rule", "verdict"]
            rows = zip(*[batch.column(n).to_pylist() for n in names])
            urls, rules, verdicts = [], [], []
            for i, (where, key, is_url, path, rule, verdict) in enumerate(rows):
                if where != current:
                    stack, current = [], where
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1].key != key:
                        stack.append(Scope(key))
                    stack[-1].add(path, (rule, verdict, len(rule)))
                    continue
                best = None
                for scope in reversed(stack):  # of equally long rules the deeper host counts
                    found = scope.longest(path)
                    if found and (best is None or found[2] > best[2]):
                        best = found
                urls.append(i)
                rules.append(best[0] if best else None)
                verdicts.append(best[1] if best else default)
            at = pa.array(urls, pa.int64())
            kept = [batch.column(n).take(at) for n in ("id", "host", "path")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"]
            )

    return run


def _range_udf(bounds: list[str], side):
    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array([side(bounds, k) for k in keys.to_pylist()], pa.int32())

    return place


def url_verdicts(
    urls: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule that fits each URL, else ``default``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the path begins
    with its path; a rule without host fits every host. Equal rules with both verdicts block. A null URL or one
    without ``://`` has an empty host and path and, unless a rule without host fits, the default. Repeated rows stay
    repeated, ids may be null, an empty table of URLs gives no rows and one of rules gives the default to all; other
    columns play no part.
    """
    spark = urls.sparkSession
    n = width(spark)
    host, path = host_and_path("url")
    read = urls.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    keyed = read.withColumn("key", host_key(F.col("host"))).withColumn(
        "sort_key", F.concat_ws("\x01", "key", F.concat_ws("\x00", F.col("path"), F.hex(F.xxhash64("id"))))
    )
    # cut points only balance the ranges: a sample of a fixed number of keys per range
    total = read.count()
    share = min(1.0, SAMPLE_PER_RANGE * n / max(1, total))
    seen = sorted(r[0] for r in keyed.select("sort_key").sample(share, 7).collect())
    bounds = [seen[k * len(seen) // n] for k in range(1, n)] if seen else []

    rule_host = F.translate(F.coalesce(F.col("host").cast("string"), F.lit("")), UPPER, LOWER)
    scopes = rules.select(
        F.when(rule_host == "", F.lit("")).otherwise(host_key(rule_host)).alias("key"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        rule_host.alias("host"), "verdict",
    ).withColumn("rule", F.concat("host", "path"))
    first, last = _range_udf(bounds, bisect_right), _range_udf(bounds, bisect_left)
    spread = scopes.withColumns({"from_": first("key"), "to_": last(F.concat("key", F.lit(LAST)))}).withColumn(
        "range_", F.explode(F.sequence("from_", "to_"))
    )
    kind = dict(keyed.dtypes)["id"]
    rows = keyed.select(
        first("sort_key").alias("range_"), "sort_key", F.lit(True).alias("is_url"), "id", "host", "path", "key",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    ).unionByName(spread.select(
        "range_", F.col("key").alias("sort_key"), F.lit(False).alias("is_url"), F.lit(None).cast(kind).alias("id"),
        "host", "path", "key", "rule", "verdict",
    ))
    swept = (
        rows.repartitionByRange(n, "range_")
        .sortWithinPartitions("range_", "sort_key", "is_url", "path")
        .mapInArrow(sweep(default), f"id {kind}, host string, path string, rule string, verdict string")
    )
    return swept.withColumnRenamed("id", page_id)
