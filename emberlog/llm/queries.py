"""Registered queries of the operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import credentials, decontaminate, fim, fingerprints, langid, licenses, line_dedup, mixing, near_dedup, pii, toxicity, warc, whitening
from emberlog.llm.common import table


def op1_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_classifier_chain_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("digest")


def op6_log_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring(table(spark, sf_dir, "documents"))


def op7_positional_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op11_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op12_piece_table_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_credential_links": op1_credential_links,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_warc_chunk_table": op3_warc_chunk_table,
    "op4_classifier_chain_toxicity": op4_classifier_chain_toxicity,
    "op5_entropy_balanced_mix": op5_entropy_balanced_mix,
    "op6_log_template_line_dedup": op6_log_template_line_dedup,
    "op7_positional_license_index": op7_positional_license_index,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_nearest_centroid_language": op9_nearest_centroid_language,
    "op10_simhash_fingerprints": op10_simhash_fingerprints,
    "op11_boosted_pii": op11_boosted_pii,
    "op12_piece_table_fim": op12_piece_table_fim,
    "op13_lanczos_whitening": op13_lanczos_whitening,
}
ORACLE: dict[str, str] = {
    "op7_positional_license_index": licenses.SQL,
    "op6_log_template_line_dedup": line_dedup.SQL,
    "op12_piece_table_fim": fim.SQL,
    "op3_warc_chunk_table": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        d as (select page_id, octet_length(encode(body)) as n, sha1(body) as h from p),
        f as (select h, n, min(page_id) as first from d group by all),
        b as (
          select d.page_id, d.n, f.first,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(
              (cast('0x' || substr(d.h, 1 + 5 * (i // 4), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1)), 'string_agg', '') as digest
          from d join f using (h, n))
        select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
          case when page_id = first then 'response' else 'revisit' end as record_type,
          case when page_id <> first then first end as refers_to
        from b""",
}
