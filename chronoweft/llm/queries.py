"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from .token_counts import op9_token_counts
from .urlfilter import OP10_SQL, op10_url_filters
from .ann import op7_nearest_neighbours
from .embdedup import op6_embedding_near_dedup
from .mixing import op5_mixing
from .pii import op4_pii
from .quality import op2_quality_classifier
from .sentencepiece_codec import op3_sentencepiece_encode_decode
from .substrings import op1_substring_dedup
from .simhash import op8_simhash_near_dedup

QUERIES = {
    "op5_mixing": op5_mixing,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_url_filters": op10_url_filters,
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece_encode_decode": op3_sentencepiece_encode_decode,
    "op4_pii": op4_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op10_url_filters": OP10_SQL,
}
