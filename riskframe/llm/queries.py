"""Registered queries of the operators in this package, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm.collocations import collocations
from riskframe.llm.common import prepared
from riskframe.llm.fingerprint import compare_with_edit
from riskframe.llm.html_text import extract_pages
from riskframe.llm.kneser_ney import scored, train as train_lm
from riskframe.llm.mixing import MIX_SQL, mix
from riskframe.llm.near_dedup import near_duplicates
from riskframe.llm.pieces import encode_documents
from riskframe.llm.pii import fit as fit_pii, personal_data
from riskframe.llm.quality_rules import quality
from riskframe.llm.topk_search import top_k
from riskframe.llm.toxicity import held_out, learn_from_labels, toxicity
from riskframe.llm.url_filter import url_verdicts
from riskframe.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_compression_rules")
def op9(spark, sf_dir):
    """Counts, compression bands and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", quality("text").alias("q"))
    return docs.select("doc_id", "q.*")


@query(
    "op6_sainte_lague_mix",
    "WITH " + MIX_SQL.replace("{docs}", "documents")
    + " SELECT doc_id, size, source_size, target, (whole * size + n_words)::BIGINT AS taken FROM mixed",
)
def op6(spark, sf_dir):
    """Words the mix takes of every document, beside its source's target."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# The rules of the query.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    "op10_url_ranges",
    """
    WITH rules(rule_host, rule_path, judged) AS (
      VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    rest AS (
      SELECT row_number() OVER () AS row_no, page_id,
             CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT row_no, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rest),
    urls AS (
      SELECT row_no, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts),
    fits AS (
      SELECT u.*, r.rule_host || r.rule_path AS rule, r.judged,
             row_number() OVER (PARTITION BY u.row_no ORDER BY length(r.rule_host || r.rule_path) DESC) AS place
      FROM urls u LEFT JOIN rules r
        ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
    SELECT page_id, host, path, rule, coalesce(judged, 'allow') AS verdict FROM fits WHERE place = 1
    """,
)
def op10(spark, sf_dir):
    """The longest rule and the verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


@query("op5_scaled_sketch")
def op5(spark, sf_dir):
    """Fingerprints of every document and its edited text, and how near they and the next document are."""
    return compare_with_edit(table(spark, sf_dir, "documents"))


@query("op1_toxicity_ngrams")
def op1(spark, sf_dir):
    """Toxicity score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn_from_labels(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3))
    scored = docs.select("doc_id", held_out("doc_id", 3).alias("held_out"), toxicity(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op4_pii_semi_markov")
def op4(spark, sf_dir):
    """Personal data of every document: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", personal_data(fit_pii(docs), "text").alias("p")).select("doc_id", "p.*")


@query("op2_tag_path_text")
def op2(spark, sf_dir):
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op3_minhash_groups")
def op3(spark, sf_dir):
    """Shingle count and near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_suffix_array_pieces")
def op7(spark, sf_dir):
    """Ids of every document, their number, and whether they decode to the document."""
    return encode_documents(table(spark, sf_dir, "documents"))


@query("op8_kneser_ney_scores")
def op8(spark, sf_dir):
    """Base and model score of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train_lm(docs.filter(~held_out("doc_id", 5)))
    scores = docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), scored(model, "text").alias("s"))
    return scores.select(
        "doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "s.base_score", "s.score", "s.perplexity",
    )


@query(
    "op11_block_top_k",
    """
    WITH vectors AS (
      SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    scores AS (
      SELECT q.row_no, q.vec_id AS query_id, v.vec_id, v.row_no AS other, list_inner_product(q.x, v.x)::BIGINT AS score
      FROM vectors q JOIN vectors v ON q.row_no <> v.row_no WHERE q.vec_id % 50 = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank FROM scores)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op11(spark, sf_dir):
    """The five highest integer inner products of every fiftieth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op12_tiled_collocations",
    r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda w: w <> '') AS w FROM pieces),
    sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
    grams AS (
      SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(
        range(1, len(w) - m + 2), lambda i: {'m': m, 'words': w[i:i + m - 1]})))) AS g FROM words WHERE len(w) > 0),
    f AS (SELECT lang, g.m AS m, g.words AS words, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
    cuts AS (
      SELECT p.lang, p.words, p.m, p.f AS a, unnest(range(1, p.m)) AS k FROM f p WHERE p.m > 1),
    scored AS (
      SELECT c.lang, c.words, c.m, c.a, c.k, l.f AS l, r.f AS r, s.n::BIGINT AS n,
             ((1000::HUGEINT * c.a * s.n::HUGEINT) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cuts c JOIN f l ON l.lang = c.lang AND l.words = c.words[1:c.k]
      JOIN f r ON r.lang = c.lang AND r.words = c.words[c.k + 1:] JOIN sizes s ON s.lang = c.lang),
    lowest AS (
      SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM scored),
    inside AS (
      SELECT DISTINCT lang, words[i:i + m2 - 1] AS words, f AS a FROM (
        SELECT lang, words, f, m, unnest(range(2, m)) AS m2 FROM f WHERE m > 2) t, range(1, 5) i(i) WHERE i + m2 - 1 <= m),
    kept AS (SELECT * FROM lowest WHERE place = 1 AND (lang, words, a) NOT IN (SELECT (lang, words, a) FROM inside)),
    ranked AS (
      SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score,
             row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM kept)
    SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
)
def op12(spark, sf_dir):
    """Each language's 2000 best phrases of two to five words."""
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_refined_whitening")
def op13(spark, sf_dir):
    """Whitened leading components of every embedding."""
    return whitened(table(spark, sf_dir, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline, from the documents to their ids."""
    return corpus_pipeline.run(spark, sf_dir)
