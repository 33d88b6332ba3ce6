"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1_mixing as op1
from . import op2_quality as op2
from . import op3_secrets as op3
from . import op4_embedding_dedup as op4
from . import op5_toxicity as op5
from . import op6_substring_dedup as op6
from . import op7_ngram_join as op7
from . import op8_pii as op8
from . import op9_line_dedup as op9
from . import op10_decontamination as op10
from . import op11_schema_rewrite as op11
from . import op12_fill_in_middle as op12
from . import op13_chat_format as op13

QUERIES = {
    "op1_mixing": op1.op1_mixing,
    "op2_quality": op2.op2_quality,
    "op3_secrets": op3.op3_secrets,
    "op4_embedding_dedup": op4.op4_embedding_dedup,
    "op5_toxicity": op5.op5_toxicity,
    "op6_substring_dedup": op6.op6_substring_dedup,
    "op7_ngram_join": op7.op7_ngram_join,
    "op8_pii": op8.op8_pii,
    "op9_line_dedup": op9.op9_line_dedup,
    "op10_decontamination": op10.op10_decontamination,
    "op11_schema_rewrite": op11.op11_schema_rewrite,
    "op12_fill_in_middle": op12.op12_fill_in_middle,
    "op13_chat_format": op13.op13_chat_format,
}
SQL = {**op4.SQL, **op6.SQL, **op7.SQL, **op9.SQL, **op10.SQL, **op12.SQL, **op13.SQL}
