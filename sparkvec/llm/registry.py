"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkvec.llm import automaton, content_store, exact_dedup, fingerprints, near_dedup, packing, quality_mil, secret_scan, toxicity, warc

QUERIES = {
    "op1_token_store": content_store.op1_token_store,
    "op2_warc": warc.op2_warc,
    "op3_bpe_automaton": automaton.op3_bpe_automaton,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_mil": quality_mil.op5_quality_mil,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_minhash_dedup": near_dedup.op8_minhash_dedup,
    "op9_packing": packing.op9_packing,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}
ORACLE_SQL = {"op2_warc": warc.ORACLE_SQL, "op6_exact_dedup": exact_dedup.ORACLE_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
