"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP2_SQL, op2_decontaminate
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .langid import op5_language_id
from .licenses import OP4_SQL, op4_license_scan
from .line_chunks import OP10_SQL, op10_line_chunks
from .mixing import OP7_SQL, op7_mix_sources
from .ppm import op9_ppm_score
from .quality import OP8_SQL, op8_line_quality
from .sharding import op6_kd_shards
from .suffix_dedup import OP1_SQL, op1_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_kd_shards": op6_kd_shards,
    "op7_mix_sources": op7_mix_sources,
    "op8_line_quality": op8_line_quality,
    "op9_ppm_score": op9_ppm_score,
    "op10_line_chunks": op10_line_chunks,
}

#: op5, op6, op9 and the pipeline have none: a trained network, data-driven splits and a byte trie are not SQL. Tests compare op9 with a plain trie, op5 with held-out
#: labels, and check op6's sizes, digests, slots, balance and groups of copies; of the pipeline they check columns, row counts and what its first stage rejects.
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op7_mix_sources": OP7_SQL,
    "op8_line_quality": OP8_SQL,
    "op10_line_chunks": OP10_SQL,
}
