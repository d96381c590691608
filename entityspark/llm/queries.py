"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import neighbours
from .decontaminate import op2_decontamination
from .jaccard import op6_jaccard_join
from .mixing import op4_mixing
from .neighbours import op9_neighbours
from .pii import op8_pii
from .quality import op10_quality
from .records import op5_token_records
from .scoring import op3_pseudo_likelihood
from .secrets import op1_secret_scan
from .toxicity import op7_toxicity

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontamination": op2_decontamination,
    "op3_pseudo_likelihood": op3_pseudo_likelihood,
    "op4_mixing": op4_mixing,
    "op5_token_records": op5_token_records,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_neighbours": op9_neighbours,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op9_neighbours": neighbours.ORACLE,
}
