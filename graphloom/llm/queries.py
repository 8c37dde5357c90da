"""The registered query of each corpus operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, neardup, neighbours, pii, quality, secrets, toxicity, urls, warc

#: The public rank file that queries and the pipeline encode with.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classified(docs, table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANK_FILE)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages")).drop("alias_class")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neardup": op1_neardup,
        "op2_pii": op2_pii,
        "op3_warc": op3_warc,
        "op4_secrets": op4_secrets,
        "op5_toxicity": op5_toxicity,
        "op6_quality": op6_quality,
        "op7_decontaminate": op7_decontaminate,
        "op8_bpe": op8_bpe,
        "op9_neighbours": op9_neighbours,
        "op10_urls": op10_urls,
    }


OP3_WARC_SQL = """
WITH page AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), largest AS (
  SELECT payload_digest, max(page_id) AS response FROM page WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN l.response IS NULL OR p.page_id IS NOT DISTINCT FROM l.response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN l.response IS NULL OR p.page_id IS NOT DISTINCT FROM l.response THEN NULL ELSE l.response END AS refers_to
FROM page p LEFT JOIN largest l ON p.payload_bytes >= 1000 AND p.payload_digest = l.payload_digest
"""


_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.name}', '{r.verdict}')" for r in urls.RULES)
#: The rules, and allow beyond them: all that there is for pages without canonical links and redirects, as those of
#: the given tables are. Alias classes are held against a search of the graph in tests/llm.
OP10_URLS_SQL = f"""
WITH page AS (
  SELECT row_number() OVER () AS n, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM pages
), rules(rule_host, rule_path, rule, verdict) AS (VALUES {_RULE_ROWS}), best AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM page, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM page LEFT JOIN best USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op10_urls": OP10_URLS_SQL,
        "op3_warc": OP3_WARC_SQL,
    }
