"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecspark.llm.common import shared_dir, table
from vecspark.llm.exact_dedup import exact_dedup
from vecspark.llm.fertility import fertility_rules
from vecspark.llm.html_template import main_text
from vecspark.llm.language_id import identify
from vecspark.llm.packing import pack
from vecspark.llm.rule_ensemble import classify
from vecspark.llm.segmentation import segmentations
from vecspark.llm.sharding import hypergeometric_shards
from vecspark.llm.simhash import near_duplicates
from vecspark.llm.token_file import read_tokens, write_tokens


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024, end_id=0)


def op4_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2, digest=True)


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypergeometric_shards(table(spark, sf_dir, "documents"))


def op6_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_file, op2_exact_dedup, op3_pack, op4_segmentations, op5_hypergeometric_shards, op6_fertility_rules, op7_language_id, op8_simhash, op9_rule_ensemble, op10_html_template)}


#: DuckDB SQL of the rows that a query returns, where SQL can say it.
ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bytes FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bytes) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(bytes) AS text_sha256
        FROM rows WINDOW w AS (PARTITION BY bytes ORDER BY points DESC, doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
