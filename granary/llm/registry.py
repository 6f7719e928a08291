"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .fingerprints import op13_fingerprints
from .infill import OP11_SQL, op11_infill
from .jaccard import OP3_SQL, op3_jaccard
from .licenses import OP8_SQL, op8_licenses
from .lm import op7_lm_scores
from .mixing import OP1_SQL, op1_mixing
from .packing import op5_packing
from .quality import op9_quality
from .repeats import OP10_SQL, op10_repeats
from .tokens import op6_token_counts
from .vectors import OP2_SQL, op2_near_vectors, op4_nearest
from .whitening import op12_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_near_vectors": op2_near_vectors,
    "op3_jaccard": op3_jaccard,
    "op4_nearest": op4_nearest,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scores": op7_lm_scores,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_repeats": op10_repeats,
    "op11_infill": op11_infill,
    "op12_whitening": op12_whitening,
    "op13_fingerprints": op13_fingerprints,
}
SQL = {"op1_mixing": OP1_SQL, "op2_near_vectors": OP2_SQL, "op3_jaccard": OP3_SQL, "op8_licenses": OP8_SQL, "op10_repeats": OP10_SQL, "op11_infill": OP11_SQL}
