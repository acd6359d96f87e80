"""The ``opN_`` queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from playtide.llm.decontamination import ORACLE_SQL as _DECONTAMINATION_SQL
from playtide.llm.decontamination import op3_decontamination
from playtide.llm.hilbert_sharding import op10_hilbert_sharding
from playtide.llm.importance_resampling import ORACLE_SQL as _RESAMPLING_SQL
from playtide.llm.importance_resampling import op11_importance_resampling
from playtide.llm.language_id import op1_language_id
from playtide.llm.near_dedup import ORACLE_SQL as _NEAR_DEDUP_SQL
from playtide.llm.near_dedup import op4_minhash_near_dedup
from playtide.llm.norm_search import ORACLE_SQL as _SEARCH_SQL
from playtide.llm.norm_search import op13_norm_search
from playtide.llm.packing import op8_packing
from playtide.llm.pii import op2_pii
from playtide.llm.quality_compression import op6_quality_compression
from playtide.llm.quality_rules import ORACLE_SQL as _QUALITY_RULES_SQL
from playtide.llm.quality_rules import op7_quality_rules
from playtide.llm.secret_scan import op5_secret_scan
from playtide.llm.spelling_variants import ORACLE_SQL as _SPELLING_SQL
from playtide.llm.spelling_variants import op12_spelling_variants
from playtide.llm.substring_dedup import op9_substring_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_compression": op6_quality_compression,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_hilbert_sharding": op10_hilbert_sharding,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_norm_search": op13_norm_search,
}

ORACLE_SQL = {
    "op3_decontamination": _DECONTAMINATION_SQL,
    "op4_minhash_near_dedup": _NEAR_DEDUP_SQL,
    "op7_quality_rules": _QUALITY_RULES_SQL,
    "op11_importance_resampling": _RESAMPLING_SQL,
    "op12_spelling_variants": _SPELLING_SQL,
    "op13_norm_search": _SEARCH_SQL,
}
