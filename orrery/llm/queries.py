"""Queries over the driver tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .langid import op4_language_id
from .media import op8_media_columns
from .mixing import OP7_SQL, op7_source_mix
from .neardup import op2_minhash_neardup
from .packing import op6_best_fit_packing
from .quality import OP1_SQL, op1_quality_rules
from .suffixdedup import op3_suffix_dedup
from .token_files import op10_token_files
from .toxicity import op9_toxicity
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_source_mix": op7_source_mix,
    "op8_media_columns": op8_media_columns,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
}
ORACLES = {"op1_quality_rules": OP1_SQL, "op5_warc": OP5_SQL, "op7_source_mix": OP7_SQL}
