"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from functools import wraps
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from beaconry.llm import (
    content_sort, language, merkle, mixing, ngram_join, packing, token_files, topk, toxicity, vector_dedup, warc, whitening, wrappers)
from beaconry.plans.shipping import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {f.__name__: _shipped(f) for f in (
    token_files.op1_token_files, ngram_join.op2_ngram_join, vector_dedup.op3_vector_dedup, mixing.op4_mix_sources, packing.op5_best_fit_packing, topk.op6_top_products, language.op7_language_id, wrappers.op8_main_text, toxicity.op9_toxicity, warc.op10_warc,
    merkle.op11_merkle_manifest, whitening.op12_whitening, content_sort.op13_content_sort,
)}

ORACLE: dict[str, str] = {"op11_merkle_manifest": merkle.ORACLE, "op13_content_sort": content_sort.ORACLE}
