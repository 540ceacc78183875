"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op1_bpe_lexicon
from .chat import OP6_SQL, op6_preference_format
from .langid import op9_language_id
from .mixing import op2_pivotal_mix
from .near_dup import op5_near_duplicates
from .pii import op4_personal_data
from .quality import op3_quality_rules
from .rtree import op11_hard_negatives
from .sharding import op10_rendezvous
from .sigtree import op13_signature_trees
from .token_files import op8_token_files
from .topk import op7_bit_sliced_top_k
from .whiten import op12_golub_kahan_whitening

QUERIES = {
    "op1_bpe_lexicon": op1_bpe_lexicon,
    "op2_pivotal_mix": op2_pivotal_mix,
    "op3_quality_rules": op3_quality_rules,
    "op4_personal_data": op4_personal_data,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_preference_format": op6_preference_format,
    "op7_bit_sliced_top_k": op7_bit_sliced_top_k,
    "op8_token_files": op8_token_files,
    "op9_language_id": op9_language_id,
    "op10_rendezvous": op10_rendezvous,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_golub_kahan_whitening": op12_golub_kahan_whitening,
    "op13_signature_trees": op13_signature_trees,
}
ORACLE_SQL: dict[str, str] = {"op6_preference_format": OP6_SQL}
