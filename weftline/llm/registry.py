"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import DECONTAMINATION_SQL, op7_decontamination
from .hard_negatives import NEGATIVES_SQL, op12_hard_negatives
from .near_dup import NEAR_DUP_SQL, op8_near_dup_join
from .packing import conversation_packing, op4_packing
from .pii import op6_pii
from .quality import RULE_COUNTS_SQL, op5_quality_rules, rule_counts
from .ranked_search import SEARCH_SQL, op13_ranked_search
from .sharding import op3_sharding
from .substring_dedup import SUBSTRING_SQL, op10_substring_dedup
from .suffix_dedup import SUFFIX_SQL, op2_suffix_dedup
from .token_counts import WORD_COUNT_SQL, op9_token_counts, word_count_rollup
from .url_filters import URL_SQL, op11_url_filters
from .warc import WARC_SQL, op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_near_dup_join": op8_near_dup_join,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
    "conversation_packing": conversation_packing,
    "word_count_rollup": word_count_rollup,
    "rule_counts": rule_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": WARC_SQL,
    "op2_suffix_dedup": SUFFIX_SQL,
    "op7_decontamination": DECONTAMINATION_SQL,
    "op8_near_dup_join": NEAR_DUP_SQL,
    "op10_substring_dedup": SUBSTRING_SQL,
    "op11_url_filters": URL_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
    "op13_ranked_search": SEARCH_SQL,
    "word_count_rollup": WORD_COUNT_SQL,
    "rule_counts": RULE_COUNTS_SQL,
}
