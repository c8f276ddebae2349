"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partloom.llm.centroids import OP12_SQL, op12_centroids
from partloom.llm.decontam import op1_decontamination
from partloom.llm.license import OP3_SQL, op3_licenses
from partloom.llm.mixing import op8_mixing
from partloom.llm.phrases import op11_phrases
from partloom.llm.quality import op9_quality
from partloom.llm.repair import op13_repair
from partloom.llm.simhash import op6_simhash
from partloom.llm.sstable import op10_token_shards
from partloom.llm.toolcalls import op7_tool_calls
from partloom.llm.topk import OP5_SQL, op5_top_k
from partloom.llm.urlfilter import OP4_SQL, op4_url_filter
from partloom.llm.warc import op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_warc": op2_warc,
        "op3_licenses": op3_licenses,
        "op4_url_filter": op4_url_filter,
        "op5_top_k": op5_top_k,
        "op6_simhash": op6_simhash,
        "op7_tool_calls": op7_tool_calls,
        "op8_mixing": op8_mixing,
        "op9_quality": op9_quality,
        "op10_token_shards": op10_token_shards,
        "op11_phrases": op11_phrases,
        "op12_centroids": op12_centroids,
        "op13_repair": op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_top_k": OP5_SQL, "op12_centroids": OP12_SQL}
