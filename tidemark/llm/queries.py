"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    byte_bpe, html_extract, imatch, importance, line_rules, masked_lm, minhash_dedup, oracle, secret_scan, source_mix,
    substring_dedup, token_counts, training_order, whitening,
)
from tidemark.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB statements by query name, where SQL can express the query.
ORACLE: dict[str, str] = {"op1_imatch": oracle.OP1, "op4_line_rules": oracle.OP4, "op9_source_mix": oracle.OP9, "op13_importance": oracle.OP13}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op7_near_duplicates(spark, sf_dir):
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


@query
def op10_repeated_windows(spark, sf_dir):
    cleaned = substring_dedup.remove_repeated_windows(documents(spark, sf_dir))
    return cleaned.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")


@query
def op4_line_rules(spark, sf_dir):
    judged = line_rules.judge_lines(documents(spark, sf_dir))
    return judged.selectExpr(
        "doc_id", "judged.n_words", "judged.word_chars", "judged.n_symbols", "judged.n_dup_lines", "judged.n_repeat_words",
        "judged.base_failed", "judged.kept", "judged.n_lines", "judged.n_failed_lines", "judged.left_chars",
    )


_SPAN = "x -> concat_ws(':', x.kind, x.start, x.end)"


@query
def op6_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    *counts, entropy = [f"cast(size(filter(spans, x -> x.kind = '{k}')) AS bigint) AS n_{k}" for k in (*secret_scan.KINDS, "entropy")]
    return found.selectExpr(
        "doc_id",
        *counts,
        f"sha2(array_join(transform(filter(spans, x -> x.kind <> 'entropy'), {_SPAN}), ','), 256) AS base_sha256",
        f"array_join(transform(spans, {_SPAN}), ',') AS spans",
        entropy,
    )


def byte_bpe_digests(coded: DataFrame) -> DataFrame:
    return coded.selectExpr(
        "doc_id",
        "cast(octet_length(ids) / 4 AS bigint) AS n_tokens",
        "sha2(ids, 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256",
    )


@query
def op8_byte_bpe(spark, sf_dir):
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe_digests(byte_bpe.encode_bytes(documents(spark, sf_dir), vocabulary=vocabulary, pattern=pattern))


@query
def op9_source_mix(spark, sf_dir):
    mixed = source_mix.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op1_imatch(spark, sf_dir):
    return imatch.fingerprints(documents(spark, sf_dir))


@query
def op2_masked_lm(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return masked_lm.score(docs, masked_lm.fit(docs))


@query
def op3_page_text(spark, sf_dir):
    found = html_extract.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.selectExpr("page_id", "url", "text", "cast(char_length(text) AS bigint) AS n_chars")


@query
def op5_training_order(spark, sf_dir):
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return training_order.stored_order(documents(spark, sf_dir), vocabulary=vocabulary, pattern=pattern)


@query
def op11_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(documents(spark, sf_dir), model=public_tokenizers.path("piece_bpe_32k.model"))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 4096 AS over_limit")


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_importance(spark, sf_dir):
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
