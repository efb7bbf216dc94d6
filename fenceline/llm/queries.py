"""The corpus operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from .filter_audit import OP11_SQL, op11_filter_audit
from .language import op9_language_id
from .lines import OP6_SQL, op6_line_dedup
from .merkle import op12_merkle_manifest
from .nbest import op3_sentencepiece_nbest
from .near_dup import op10_minhash_near_dedup
from .neighbours import OP13_SQL, op13_block_neighbours
from .packing import op7_packing
from .quality import OP1_SQL, op1_quality_rules
from .search import OP5_SQL, op5_topk_search
from .secrets import op4_secret_scan
from .token_output import op2_token_output
from .toxicity import op8_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_output": op2_token_output,
    "op3_sentencepiece_nbest": op3_sentencepiece_nbest,
    "op4_secret_scan": op4_secret_scan,
    "op5_topk_search": op5_topk_search,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_block_neighbours": op13_block_neighbours,
}
ORACLES = {
    "op1_quality_rules": OP1_SQL, "op5_topk_search": OP5_SQL, "op6_line_dedup": OP6_SQL, "op11_filter_audit": OP11_SQL, "op13_block_neighbours": OP13_SQL,
}
