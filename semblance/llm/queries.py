"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from .mixing import OP8_SQL, op8
from .neardup import OP4_SQL, op4
from .neighbours import op3
from .packing import op1
from .quality import OP10_SQL, op10
from .secrets import op7
from .substrings import OP2_SQL, op2
from .tokencount import op5
from .toxicity import op6
from .urls import op9

QUERIES = {
    "op1_pack_best_fit": op1,
    "op2_repeated_substrings": op2,
    "op3_nearest_neighbours": op3,
    "op4_near_duplicates": op4,
    "op5_token_counts": op5,
    "op6_toxicity": op6,
    "op7_secret_scan": op7,
    "op8_mix_sources": op8,
    "op9_url_filter": op9,
    "op10_quality_rules": op10,
}

SQL = {
    "op2_repeated_substrings": OP2_SQL,
    "op4_near_duplicates": OP4_SQL,
    "op8_mix_sources": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
}
