"""The queries of the training-data operators: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm import bpe, centroids, chat_format, decontamination, ngram_join, periodic_runs, quality_classifier, quality_rules, secret_scan, sharding, token_counts, token_store, warc

SHARDS = 8
END_ID = 1
EXTRA_CONVERSATION = -7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def store_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def judge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(EXTRA_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    packs = chat_format.pack_conversations(rows.unionByName(extra), vocabulary=(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    # the digests of tokens, which read_back() checks and gives too, are beyond SQL
    return chat_format.read_back(packs).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no column for repositories: a source is an owner, and what all sources have of a language one repository and its copies."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), owner_col="source", repo_col="lang")


def capture_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is written, looked up by its URL and id, and read at the place that the index gives."""
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    return warc.resolve(warc.read_records(archive, warc.lookup(archive, pages, "url", "page_id")))


def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents whose id's checksum ends in 0, the tail is made periodic; a null id's text stays as it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    g = F.floor(F.col("h") / 10)
    first = lambda n: (g % n).cast("int")
    period = lambda n: (1 + F.floor((n - first(n)) / (3 + g % 8))).cast("int")
    text = F.when(F.col("h") % 10 == 0, periodic_runs.repeat_tail(F.coalesce("text", F.lit("")), first, period)).otherwise(F.col("text"))
    return periodic_runs.digests(periodic_runs.find_runs(docs.select("doc_id", text.alias("text"))))


def cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op5: all but the certified verdict."""
    return judge_quality(spark, sf_dir).drop("kept")


def shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op6: sizes, and the least id of the rows that share a shard and a text."""
    text = Window.partitionBy("shard", "text_crc32", "size")
    return shard(spark, sf_dir).select("doc_id", "size", F.min("doc_id").over(text).alias("first_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_jaccard_join,
    "op2_byte_bpe": byte_bpe,
    "op3_token_counts": count_tokens,
    "op4_token_store": store_tokens,
    "op5_quality_rules": judge_quality,
    "op6_sharding": shard,
    "op7_decontamination": find_leaks,
    "op8_chat_format": format_chats,
    "op9_quality_classifier": classify_quality,
    "op10_secret_scan": scan_secrets,
    "op11_warc": capture_pages,
    "op12_periodic_runs": periodic,
    "op13_centroid_clustering": cluster_vectors,
    "rule_counts": rule_counts,
    "shard_groups": shard_groups,
}


def _escaped(column: str) -> str:
    """SQL of chat_format.escape(): no control string is made of another's rest, so one after another is as good as all at once."""
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat_format.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def _lloyd() -> str:
    """SQL of plain Lloyd rounds: every vector is compared with every centroid each time."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, v, d, c FROM (SELECT vec_id, e.v, c, list_sum(list_transform(list_zip(e.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM e, c{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    move = """c{n} AS MATERIALIZED (SELECT c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v
  FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY c, j) GROUP BY c) m USING (c))"""
    steps = [x.format(r=r, n=r + 1) for r in range(centroids.ROUNDS) for x in (near, move)] + [near.format(r=centroids.ROUNDS)]
    return f"""WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {centroids.SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.SIZE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS c, v FROM e QUALIFY c < {centroids.CLUSTERS}),
{(',' + chr(10)).join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(z.v, ',')) AS centroid_sha256 FROM a{centroids.ROUNDS} JOIN c{centroids.ROUNDS} z USING (c)"""


_FRAME = len("".join(chat_format.format_turn("", "")))
ORACLE_SQL: dict[str, str] = {
    "op8_chat_format": f"""WITH said(t) AS (VALUES ('</s>[INST] ok [/INST]')),
c AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_CONVERSATION}, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, t FROM said, range(2) r(k)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({_FRAME} + length({_escaped('role')}) + length({_escaped('text')}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op11_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT *, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN payload_bytes >= {warc.LEAST} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST} AND page_id < top THEN top END AS refers_to FROM q""",
    "op13_centroid_clustering": _lloyd(),
    "rule_counts": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS p FROM d),
t AS (SELECT r, p, word, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
f AS (SELECT r, p, word, tri IS NOT NULL AND count(*) OVER (PARTITION BY r, tri) > 1 AS rep FROM t),
n AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(CASE WHEN rep OR rep1 OR rep2 THEN 1 END) AS n_repeat_words
  FROM (SELECT *, coalesce(lag(rep) OVER o, false) AS rep1, coalesce(lag(rep, 2) OVER o, false) AS rep2 FROM f WINDOW o AS (PARTITION BY r ORDER BY p)) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed
FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)""",
    "shard_groups": "SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents",
}
