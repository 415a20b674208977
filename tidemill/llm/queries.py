"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.decontamination import op9_decontamination
from tidemill.llm.embedding_dedup import OP7_SQL, op7_embedding_dedup
from tidemill.llm.language_id import op8_language_id
from tidemill.llm.licenses import op2_licenses
from tidemill.llm.near_dedup import OP5_SQL, op5_near_dedup
from tidemill.llm.packing import op3_packing
from tidemill.llm.personal_data import op13_personal_data
from tidemill.llm.quality import op10_quality
from tidemill.llm.sharding import OP1_SQL, op1_sharding
from tidemill.llm.spelling import OP12_SQL, op12_spelling
from tidemill.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from tidemill.llm.token_counts import op6_token_counts
from tidemill.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling": op12_spelling,
    "op13_personal_data": op13_personal_data,
}

ORACLE_SQL: dict[str, str] = {"op1_sharding": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op5_near_dedup": OP5_SQL, "op7_embedding_dedup": OP7_SQL, "op11_vector_codes": OP11_SQL, "op12_spelling": OP12_SQL}
