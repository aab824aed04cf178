"""The queries of the operators here and of the whole pipeline, beside their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.alignment import op12_alignment
from tidewatch.llm.decontaminate import OP3_SQL, op3_decontamination
from tidewatch.llm.lines import OP4_SQL, op4_line_dedup
from tidewatch.llm.near_join import op7_near_join
from tidewatch.llm.packing import op9_packing
from tidewatch.llm.pii import op1_pii
from tidewatch.llm.quality import op6_quality
from tidewatch.llm.quality_rules import op13_quality_rules
from tidewatch.llm.quotes import OP5_SQL, op5_quotation_linking
from tidewatch.llm.sharding import op2_sharding
from tidewatch.llm.urls import op8_url_filter
from tidewatch.llm.vector_codes import OP11_SQL, op11_vector_codes
from tidewatch.llm.vectors import op10_near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_sharding,
        op3_decontamination,
        op4_line_dedup,
        op5_quotation_linking,
        op6_quality,
        op7_near_join,
        op8_url_filter,
        op9_packing,
        op10_near_vectors,
        op11_vector_codes,
        op12_alignment,
        op13_quality_rules,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op4_line_dedup": OP4_SQL, "op5_quotation_linking": OP5_SQL, "op11_vector_codes": OP11_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
