"""The opN_ queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import language_id, line_dedup, minhash, mixing, packing, quality_rules, resampling, suffix_dedup, token_counts, topk_search
from quarry.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": lambda s, d: suffix_dedup.deduplicate(documents(s, d)).drop("kept"),
        "op2_minhash": lambda s, d: minhash.near_duplicates(documents(s, d), width=4, percent=80).drop("th"),
        "op3_quality_rules": lambda s, d: quality_rules.verdicts(documents(s, d).select("doc_id", "text")),
        "op4_line_dedup": lambda s, d: line_dedup.digests(documents(s, d).select("doc_id", "text")),
        "op5_mixing": lambda s, d: mixing.weights(documents(s, d), _labels(s, d)),
        "op6_language_id": lambda s, d: language_id.identify(documents(s, d)),
        "op7_topk_search": lambda s, d: topk_search.search(documents(s, d), "doc_id % 20 = 0", k=10),
        "op8_packing": lambda s, d: packing.pack(documents(s, d)),
        "op9_token_counts": lambda s, d: token_counts.counts(documents(s, d)),
        "op10_resampling": lambda s, d: resampling.resample(documents(s, d), _labels(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.ORACLE, "op2_minhash": minhash.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op7_topk_search": topk_search.ORACLE}
