"""A corpus pipeline: quality rules, near-duplicates, secrets, source mix, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, line_rules, minhash_dedup, secret_scan, source_mix
from tidemark.llm.common import documents, saved
from tidemark.llm.queries import byte_bpe_digests

#: SQL can express neither the encoder nor the secret scan; a test repeats the pipeline by brute force.
ORACLE_SQL = None

#: Similarity from which the near-duplicate stage links documents.
PERCENT = 80


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as a struct, so that no column of ``docs`` meets a name that a stage uses."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _unwrapped(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of ``row``, with ``text`` (SQL) as the text and the characters counted again."""
    made = {"text": text, "n_chars": f"cast(char_length({text}) AS bigint)"}
    return df.selectExpr(*[f"{made.get(c, f'row.`{c}`')} AS `{c}`" for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go.

    Null, empty and blank texts have too few words and go. Every row is judged by itself, so repeated rows and ids make no difference; other columns stay as
    they are, whatever their names. An empty table stays empty.
    """
    judged = line_rules.judge_lines(_wrapped(docs)).where("judged.kept")
    return _unwrapped(judged, docs.columns, "judged.clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 80 percent) one document stays: that with the smallest id, one without an id only where none has an id.

    Rows that share id and text are one document. Null, empty and blank texts are alike to nothing; one row per id and text of them stays. Other columns
    stay as they are, whatever their names; of rows that share id and text those of any one. An empty table stays empty.
    """
    found = minhash_dedup.survivors(docs.select("doc_id", "text"), percent=PERCENT).selectExpr("doc_id AS kept_id", "text_hash AS kept_hash")
    match = F.expr("docs.doc_id <=> kept.kept_id AND xxhash64(docs.text) = kept.kept_hash")
    return docs.alias("docs").join(found.alias("kept"), match, "left_semi").dropDuplicates(["doc_id", "text"])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind.

    All rows stay, repeated ones too. A null text stays null, with n_chars null. Other columns stay as they are, whatever their names.
    """
    return _unwrapped(secret_scan.scan_secrets(_wrapped(docs), carry=["row"]), docs.columns, "redacted")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, the last time perhaps in part.

    Documents without words are not taken. A null source is a source of its own; repeated rows and ids are documents of their own. Other columns
    stay as they are, whatever their names. An empty table stays empty.
    """
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token counts and digests of the ids and of the decoded bytes, one row per row of the mix; null texts count as empty."""
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe_digests(byte_bpe.encode_bytes(docs, vocabulary=vocabulary, pattern=pattern))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scan", secrets),
    ("source mix", mix),
    ("byte BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
