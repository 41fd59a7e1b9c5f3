"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

1. Every source gets a real target (``targets``): its weight's share of all words, at most ``max_repeats`` times its
   own words; what a cap frees is shared again by weight.
2. Targets become whole blocks: seats go to the highest quotients target / (2k - 1), k = 1, 2, ...
3. A source is cut into shards of about sqrt(all documents) documents; its seats are apportioned to them alike.
4. In a shard the documents stand in a seeded order. A quota of q from n blocks takes every block q div n times and
   a run of q mod n blocks from a seeded place once more. Blocks are token ranges of that order, so a document may
   be cut at the two ends of a run.

Only (id, source, size) rows are shuffled, never texts. Windows run over one shard, over the shards of one source
(sqrt of the documents) and over the list of sources, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskframe.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix"
LEAST_SHARD_DOCS = 256
LARGEST_BLOCK = 1024
BLOCKS_PER_TARGET = 256


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(*parts: Column) -> Column:
    """The seeded hash of the parts, as hexadecimal text."""
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def as_number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, n_docs) with its number, weight and target.

    The common level L gives every source min(cap, L * weight). With sources by cap / weight, L is the largest of
    (words left after capping all earlier ones) / (weights left).
    """
    whole = W.partitionBy(F.lit(0))
    by_ratio = whole.orderBy("ratio", "source_no").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    )
    n = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((n - 1) % len(WEIGHTS) + 1).cast("int"))
    return (
        sources.withColumns({"source_no": n, "weight": weight.cast("long"), "cap": MAX_REPEATS * F.col("source_size")})
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight")))
        .drop("ratio", "level")
    )


def sainte_lague(units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Integer quotas of ``seats`` (one number per group) by highest quotients of ``claim``, at most ``most`` each.

    Seats that a unit surely gets are given at once: its final number differs from its exact share of the seats by
    at most half a seat per unit of the group, in proportion, and one. Only the seats in between are ranked.
    """
    group = W.partitionBy(*(keys or [F.lit(0)]))
    total = F.sum("claim").over(group)
    share = F.when(total > 0, F.col("claim") / total).otherwise(F.lit(0.0))
    margin = share * F.count(F.lit(1)).over(group) + 2
    known = (
        units.withColumns({"share_": share, "margin_": margin})
        .withColumn("low_", F.least(F.col("most"), F.greatest(F.lit(0), F.floor(F.col("seats") * F.col("share_") - F.col("margin_"))).cast("long")))
        .withColumn("high_", F.least(F.col("most"), F.ceil(F.col("seats") * F.col("share_") + F.col("margin_")).cast("long")))
        .withColumn("left_", F.col("seats") - F.sum("low_").over(group))
    )
    ranked = known.withColumn(
        "k", F.explode_outer(F.when((F.col("high_") > F.col("low_")) & (F.col("claim") > 0), F.sequence(F.col("low_") + 1, F.col("high_"))))
    ).withColumn("place", F.row_number().over(group.orderBy((F.col("claim") / (2 * F.col("k") - 1)).desc_nulls_last(), order)))
    won = F.sum(F.when(F.col("k").isNotNull() & (F.col("place") <= F.col("left_")), 1).otherwise(0))
    kept = [c for c in units.columns]
    return ranked.groupBy(*kept, "low_").agg(won.cast("long").alias("won_")).select(
        *kept, (F.col("low_") + F.col("won_")).alias("quota")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """What the mix takes of every document; with ``carry`` each row also brings its input row as the struct ``row``.

    Returns doc_id, size (words), source_size, target (of the document's source), taken (words, repeats counted),
    whole (times the whole document is taken) and first_word, n_words: the run of words taken once more. The rows
    of the input are those of the result: a null text has size 0 and takes 0, as has an empty one; null is a source
    of its own, last in order; repeated rows are rows of their own; rows with one id and one size are
    interchangeable; an empty table gives an empty result. Other columns play no part.
    """
    own = [F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size")]
    sizes = stored(docs.select(*own), "mix-sizes")
    rows = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if carry else sizes
    by_source = targets(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    )
    whole = W.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
    by_source = by_source.withColumn(
        "block",
        F.least(F.lit(float(LARGEST_BLOCK)), F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(least / BLOCKS_PER_TARGET))))).cast("long"),
    ).withColumn(
        "n_shards",
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.greatest(F.lit(LEAST_SHARD_DOCS), F.ceil(F.sqrt(F.sum("n_docs").over(whole)))))).cast("long"),
    )
    by_source = stored(by_source, "mix-sources")  # read by three branches: one small table

    digest = hashed(F.col("doc_id"))

    def put(frame: DataFrame) -> DataFrame:
        # documents without words take nothing: they are spread, not ordered
        spread = -1 - as_number(F.col("digest")) % (1 << 20)
        return (
            frame.withColumnRenamed("source", "name").join(by_source, F.col("name").eqNullSafe(F.col("source"))).withColumn("digest", digest)
            .withColumn("shard", F.when(F.col("size") > 0, as_number(F.col("digest")) % F.col("n_shards")).otherwise(spread))
        )

    shards = (
        put(sizes).filter("size > 0").groupBy("source_no", "shard").agg(F.sum("size").alias("words"))
        .join(by_source.select("source_no", "target", "block", "source_size"), "source_no")
        .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / F.col("block"))).cast("long"))
    )
    shards = stored(shards, "mix-shards")
    source_seats = (
        shards.groupBy("source_no").agg((MAX_REPEATS * F.sum("blocks")).alias("most"))
        .join(by_source.select("source_no", F.col("target").alias("claim"), "block"), "source_no")
        .withColumn("seats", F.round(F.sum("claim").over(whole) / F.col("block")).cast("long"))
    )
    quotas = sainte_lague(source_seats, [], "source_no").select("source_no", F.col("quota").alias("seats"))
    runs = sainte_lague(
        shards.join(quotas, "source_no").select(
            "source_no", "shard", "words", "blocks", F.col("words").cast("double").alias("claim"), (MAX_REPEATS * F.col("blocks")).alias("most"), "seats"
        ),
        ["source_no"], "shard",
    )
    runs = (
        runs.withColumn("again", F.col("quota") % F.col("blocks"))
        .withColumn("start", as_number(hashed(F.col("source_no"), F.col("shard"))) % (F.col("blocks") - F.col("again") + 1))
        .select(
            "source_no", "shard", F.expr("quota div blocks").alias("whole"),
            F.expr("start * words div blocks").alias("run_from"), F.expr("(start + again) * words div blocks").alias("run_to"),
        )
    )
    end = F.sum("size").over(
        W.partitionBy("source_no", "shard").orderBy("digest", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    taken = put(rows).withColumn("end", end).join(runs, ["source_no", "shard"], "left").withColumns({
        "first_word": F.greatest(F.lit(0), F.col("run_from") - (F.col("end") - F.col("size"))),
        "last_word": F.least(F.col("size"), F.col("run_to") - (F.col("end") - F.col("size"))),
    })
    n_words = F.coalesce(F.greatest(F.lit(0), F.col("last_word") - F.col("first_word")), F.lit(0))
    times = F.coalesce(F.col("whole"), F.lit(0))
    return taken.select(
        "doc_id", "size", "source_size", "target", (times * F.col("size") + n_words).alias("taken"),
        times.alias("whole"), F.when(n_words > 0, F.col("first_word")).otherwise(0).alias("first_word"), n_words.alias("n_words"),
        *(["row"] if carry else []),
    )


def words_from(text: Column, first: Column, n: Column) -> Column:
    """``n`` words of the text from the given one on, with the white space between and after them."""
    pieces = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, (first + 1).cast("int"), n.cast("int")), "")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, with the columns of the input: a row for every time a document is taken whole, and one for the
    part of it that a run takes once more. Documents that the mix does not take, and those without words, go."""
    taken = mix(docs, doc_id, text, source, carry=True)
    part = F.when(F.col("n_words") == F.col("size"), F.col(f"row.{text}")).otherwise(
        words_from(F.col(f"row.{text}"), F.col("first_word"), F.col("n_words"))
    )
    copies = F.concat(
        F.array_repeat(F.col(f"row.{text}"), F.col("whole").cast("int")),
        F.when(F.col("n_words") > 0, F.array(part)).otherwise(F.array().cast("array<string>")),
    )
    exploded = taken.filter("size > 0 and taken > 0").select("row", F.explode(copies).alias("copy"))
    return exploded.select(*[F.col("copy").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


# The same steps as SQL. {docs} holds doc_id, text and source.
MIX_SQL = r"""
sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM {docs}),
s1 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (WHERE size > 0) AS n_docs FROM sizes GROUP BY source),
s2 AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, ((source_no - 1) % 3 + 1) AS weight FROM s2),
s4 AS (SELECT *, cap::DOUBLE / weight AS ratio FROM s3),
s5 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM s4 WINDOW b AS (ORDER BY ratio, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s6 AS (SELECT *, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM s5),
s7 AS (
  SELECT *, least(1024.0, greatest(1.0, pow(2.0, floor(log2((min(CASE WHEN target > 0 THEN target END) OVER ()) / 256.0)))))::BIGINT AS block,
         greatest(1, ceil(n_docs / greatest(256.0, ceil(sqrt((sum(n_docs) OVER ())::DOUBLE)))))::BIGINT AS n_shards
  FROM s6),
placed AS (
  SELECT d.*, s.source_no, s.source_size, s.target, s.block,
         CASE WHEN size > 0 THEN ('0x' || substr(digest, 1, 8))::BIGINT % s.n_shards END AS shard
  FROM sizes d JOIN s7 s ON d.source IS NOT DISTINCT FROM s.source),
shards AS (
  SELECT source_no, shard, sum(size)::BIGINT AS words, greatest(1, round(sum(size)::DOUBLE / any_value(block)))::BIGINT AS blocks
  FROM placed WHERE size > 0 GROUP BY source_no, shard),
u1 AS (
  SELECT p.source_no, any_value(s.target) AS claim, 3 * sum(p.blocks)::BIGINT AS most, any_value(s.block) AS block
  FROM shards p JOIN s7 s USING (source_no) GROUP BY p.source_no),
u2 AS (SELECT *, round(sum(claim) OVER () / block)::BIGINT AS seats FROM u1),
u3 AS (SELECT *, CASE WHEN sum(claim) OVER () > 0 THEN claim / sum(claim) OVER () ELSE 0 END AS share, count(*) OVER () AS n FROM u2),
u4 AS (
  SELECT *, least(most, greatest(0, floor(seats * share - (share * n + 2))::BIGINT)) AS low,
         least(most, ceil(seats * share + (share * n + 2))::BIGINT) AS high FROM u3),
u5 AS (SELECT *, seats - sum(low) OVER () AS remaining FROM u4),
u6 AS (SELECT source_no, claim, remaining, unnest(generate_series(low + 1, high)) AS k FROM u5 WHERE high > low AND claim > 0),
u7 AS (SELECT *, row_number() OVER (ORDER BY claim / (2 * k - 1) DESC, source_no) AS place FROM u6),
u8 AS (SELECT source_no, count(*) AS won FROM u7 WHERE place <= remaining GROUP BY source_no),
quotas AS (SELECT u5.source_no, low + coalesce(won, 0) AS seats FROM u5 LEFT JOIN u8 USING (source_no)),
v1 AS (SELECT s.*, words::DOUBLE AS claim, 3 * blocks AS most, q.seats FROM shards s JOIN quotas q USING (source_no)),
v3 AS (
  SELECT *, CASE WHEN sum(claim) OVER w > 0 THEN claim / sum(claim) OVER w ELSE 0 END AS share, count(*) OVER w AS n
  FROM v1 WINDOW w AS (PARTITION BY source_no)),
v4 AS (
  SELECT *, least(most, greatest(0, floor(seats * share - (share * n + 2))::BIGINT)) AS low,
         least(most, ceil(seats * share + (share * n + 2))::BIGINT) AS high FROM v3),
v5 AS (SELECT *, seats - sum(low) OVER (PARTITION BY source_no) AS remaining FROM v4),
v6 AS (SELECT source_no, shard, claim, remaining, unnest(generate_series(low + 1, high)) AS k FROM v5 WHERE high > low AND claim > 0),
v7 AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY claim / (2 * k - 1) DESC, shard) AS place FROM v6),
v8 AS (SELECT source_no, shard, count(*) AS won FROM v7 WHERE place <= remaining GROUP BY source_no, shard),
r1 AS (SELECT v5.*, low + coalesce(won, 0) AS quota FROM v5 LEFT JOIN v8 USING (source_no, shard)),
r2 AS (
  SELECT *, quota % blocks AS again,
         ('0x' || substr(md5('mix:' || source_no::VARCHAR || ':' || shard::VARCHAR), 1, 8))::BIGINT % (blocks - quota % blocks + 1) AS start FROM r1),
runs AS (
  SELECT source_no, shard, quota // blocks AS whole, (start * words) // blocks AS run_from, ((start + again) * words) // blocks AS run_to FROM r2),
d1 AS (
  SELECT *, sum(size) OVER (PARTITION BY source_no, shard ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS fin
  FROM placed),
d2 AS (
  SELECT d.*, coalesce(whole, 0) AS whole, greatest(0, run_from - (fin - size)) AS first_word, least(size, run_to - (fin - size)) AS last_word
  FROM d1 d LEFT JOIN runs r ON d.source_no = r.source_no AND d.shard = r.shard),
mixed AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(0, last_word - first_word) ELSE 0 END AS n_words FROM d2)
"""
