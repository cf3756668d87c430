"""Queries of this package by name, and the SQL of those that SQL can express."""

from .ann import op5_ann
from .conversations import op12_conversation_repair
from .decontamination import OP11_SQL, op11_decontamination
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .langid import op4_language_id
from .lm import op6_lm_scoring
from .mixing import op2_mixing
from .packing import op9_best_fit_packing
from .pii import op10_pii
from .simhash import op1_simhash
from .suffix_dedup import op7_suffix_dedup
from .toxicity import op3_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_ann": op5_ann,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_pii": op10_pii,
    "op11_decontamination": op11_decontamination,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op8_exact_dedup": OP8_SQL,
    "op11_decontamination": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
