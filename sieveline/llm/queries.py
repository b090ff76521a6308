"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .alignment import op13_alignment
from .bpe import op7_bpe
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .language_id import op4_language_id
from .licenses import OP3_SQL, op3_licenses
from .minhash import OP6_SQL, op6_minhash
from .packing import op10_packing
from .secrets import OP12_SQL, op12_secrets
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .suffix_dedup import OP2_SQL, op2_suffix_dedup
from .topk import OP8_SQL, op8_topk
from .toxicity import op5_toxicity
from .whitening import op11_whitening

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_licenses": op3_licenses,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_minhash": op6_minhash,
    "op7_bpe": op7_bpe,
    "op8_topk": op8_topk,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_secrets": op12_secrets,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op3_licenses": OP3_SQL,
    "op6_minhash": OP6_SQL,
    "op8_topk": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op12_secrets": OP12_SQL,
}
