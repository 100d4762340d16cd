"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.covertree import op10_embeddings
from tallyforge.llm.langid import op3_language
from tallyforge.llm.mixing import OP6_SQL, op6_mixing
from tallyforge.llm.packing import op7_packing
from tallyforge.llm.pii import op5_pii
from tallyforge.llm.quality import op2_quality
from tallyforge.llm.secretscan import op9_secrets
from tallyforge.llm.simhash import op4_simhash
from tallyforge.llm.tokens import op1_token_counts
from tallyforge.llm.urlfilter import op8_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_urls": op8_urls,
    "op9_secrets": op9_secrets,
    "op10_embeddings": op10_embeddings,
}

ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL}
