"""The registered queries of this subpackage: thin callers of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from placelens.llm import (
    decontamination,
    embedding_dedup,
    jaccard_join,
    lm_scoring,
    merkle_manifest,
    oracles,
    quality_classifier,
    secret_scan,
    sentencepiece_bpe,
    spelling_variants,
    suffix_dedup,
    token_counts,
    url_filter,
    warc_archive,
)

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_bpe.read_model(public_tokenizers.path(MODEL))
    coded = sentencepiece_bpe.decode(sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), model), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"))
    return scored.withColumn("held_out", lm_scoring.is_held_out(F.col("doc_id"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.report(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = secret_scan.joined_spans(F.col("spans"))
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_classifier.classify(documents, quality_classifier.fit(documents, table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("source")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_bpe.read_model(public_tokenizers.path(MODEL))
    return token_counts.with_limit(token_counts.count_tokens(table(spark, sf_dir, "documents"), model), TOKEN_LIMIT)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_archive.index_of(spark, warc_archive.archive_pages(table(spark, sf_dir, "pages")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filter": op10_url_filter,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_warc": op12_warc,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    # no page of the given tables has aliases, so that the rules alone decide; tests cover the aliases
    "op10_url_filter": r"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(h, s, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best as (
  select page_id, arg_max(h || s, length(h || s)) as rule, arg_max(v, length(h || s)) as verdict
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join best using (page_id)
""",
    "op11_spelling_variants": oracles.SPELLING,
    "op13_merkle_manifest": oracles.merkle(),
    # base32 by groups of five hexadecimal digits, each four characters
    "op12_warc": r"""
with p as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html, sha1(coalesce(html, '')) as d from pages),
host as (
  select *, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as h,
         case when contains(url, '://') then regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) else '/' || regexp_extract(url, '^[^#]*') end as rest,
         min(page_id) over (partition by d) as first
  from p),
keyed as (
  select *, array_to_string(list_reverse(string_split(h, '.')), ',') || ')' || rest as url_key,
         list_transform(range(8), lambda k: ('0x' || substr(d, 5 * k + 1, 5))::bigint) as g
  from host)
select page_id, strlen(html)::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((g[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1)::int, 1)), '') as payload_digest,
       case when first is not distinct from page_id then 'response' else 'revisit' end as record_type,
       case when first is distinct from page_id then first end as refers_to,
       url_key, row_number() over (order by url_key, page_id) - 1 as position
from keyed
""",
}
