"""Queries of this subpackage for ``__spark_entry__.py``, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, langid, lm, packing, quality, simhash, substring_dedup, toxicity, trie, urls, variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_chat": chat.op2_chat,
        "op3_simhash": simhash.op3_simhash,
        "op4_quality": quality.op4_quality,
        "op5_langid": langid.op5_langid,
        "op6_urls": urls.op6_urls,
        "op7_packing": packing.op7_packing,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_lm": lm.op10_lm,
        "op11_variants": variants.op11_variants,
        "op12_bpe": bpe.op12_bpe,
        "op13_trie": trie.op13_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.sql(),
        "op2_chat": chat.sql(),
        "op4_quality": quality.sql(),
        "op6_urls": urls.sql(),
        "op9_substring_dedup": substring_dedup.sql(),
        "op11_variants": variants.sql(),
        "op13_trie": trie.sql(),
    }
