"""Queries of the training-data operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import langid, line_dedup, maxscore, mixing, packing, permutation_index, simhash, suffix_dedup, toxicity, url_filters
from quarry.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    one = lambda f, name: lambda spark, sf_dir: f(table(spark, sf_dir, name))
    return {
        "op1_permutation_index": one(permutation_index.query, "embeddings"),
        "op2_simhash": one(simhash.query, "documents"),
        "op3_langid": one(langid.query, "documents"),
        "op4_url_filters": one(url_filters.query, "pages"),
        "op5_mixing": one(mixing.query, "documents"),
        "op6_line_dedup": one(line_dedup.query, "documents"),
        "op7_maxscore": one(maxscore.query, "embeddings"),
        "op8_packing": one(packing.query, "documents"),
        "op9_suffix_dedup": one(suffix_dedup.query, "documents"),
        "op10_toxicity": lambda spark, sf_dir: toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": url_filters.SQL, "op5_mixing": mixing.SQL, "op7_maxscore": maxscore.SQL}
