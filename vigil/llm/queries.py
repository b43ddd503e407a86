"""Registered queries ``opN_<name>`` and their DuckDB SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.bpe import bpe
from vigil.llm.common import table
from vigil.llm.decontam import hits
from vigil.llm.exact_dedup import dedup
from vigil.llm.langid import identify
from vigil.llm.lexical import duckdb_sql as search_sql
from vigil.llm.lexical import search
from vigil.llm.line_dedup import dedup_lines
from vigil.llm.pii import pseudonymise
from vigil.llm.prefix_trie import duckdb_sql as trie_sql
from vigil.llm.prefix_trie import trie
from vigil.llm.setsketch import duckdb_sql as set_sql
from vigil.llm.setsketch import near_duplicates as similar_sets
from vigil.llm.sharding import shard
from vigil.llm.simhash import near_duplicates
from vigil.llm.url_filter import duckdb_sql, judge
from vigil.llm.warc import archive, fetch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids and decoded text of every document, as digests."""
    return bpe(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents, nearly equal in bytes."""
    return shard(table(spark, sf_dir, "documents"), 8)


@query
def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words found in every document."""
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10) \
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.col("longest.word").alias("longest_word"),
                F.col("longest.length").alias("longest_length"), F.col("longest.item").alias("longest_item"))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal texts and the one that stays."""
    return dedup(table(spark, sf_dir, "documents"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash (4-word shingles) and component within 4 bits of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the line blocks that an earlier one holds."""
    return dedup_lines(table(spark, sf_dir, "documents"), all_pairs=True) \
        .select("doc_id", "n_lines", "n_removed", "words_removed", "partners", "text",
                F.sha2("text", 256).alias("text_sha256"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC, and read back by looking every url up."""
    pages = table(spark, sf_dir, "pages")
    path, shards = archive(pages)
    return fetch(spark, pages, path, shards) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url.  The first number in a url is the document
    the page was made from; its label (toxic or of low quality) is the page's."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.regexp_extract("url", "/([0-9]{1,18})", 1).try_cast("long").alias("of"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    labelled = pages.join(labels, pages["of"] == labels["doc_id"], "left").select("page_id", "url", "bad")
    return judge(labelled, RULES).select("page_id", "host", "path", "rule", "verdict", "template")


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    return identify(table(spark, sf_dir, "documents"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    return pseudonymise(table(spark, sf_dir, "documents"), key="registered query, no secret") \
        .select("doc_id", "n_entities", "entity_types", "text")


ORACLE["op4_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t"""

ORACLE["op8_url_filter"] = duckdb_sql(RULES, """SELECT page_id, url, bad FROM pages LEFT JOIN (
  SELECT doc_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM labels GROUP BY doc_id) l
  ON try_cast(regexp_extract(url, '/([0-9]{1,18})', 1) AS BIGINT) = l.doc_id""")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix node of the rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))


ORACLE["op11_prefix_trie"] = trie_sql()


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


ORACLE["op12_lexical"] = search_sql(k=50)


@query
def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component (5-word shingles, Jaccard 0.85) of every document."""
    return similar_sets(table(spark, sf_dir, "documents"), shingle=5, percent=85)


ORACLE["op13_setsketch"] = set_sql(shingle=5, percent=85)
