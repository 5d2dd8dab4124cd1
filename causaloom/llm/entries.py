"""The registered queries of this subpackage."""

from __future__ import annotations

from .decontam import op5_decontaminate
from .html_text import op4_html
from .infill import OP12_SQL, op12_infill
from .line_dedup import OP6_SQL, op6_line_dedup
from .lm_score import op7_lm_score
from .mixing import op2_mixing
from .ngram_join import op3_ngram_join
from .packing import op13_packing
from .quality import op1_quality
from .toxicity import op8_toxicity
from .vector_codes import OP11_SQL, op11_vector_codes
from .vector_dedup import op10_vector_dedup
from .warc import OP9_SQL, op9_warc


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_mixing": op2_mixing,
        "op3_ngram_join": op3_ngram_join,
        "op4_html": op4_html,
        "op5_decontaminate": op5_decontaminate,
        "op6_line_dedup": op6_line_dedup,
        "op7_lm_score": op7_lm_score,
        "op8_toxicity": op8_toxicity,
        "op9_warc": op9_warc,
        "op10_vector_dedup": op10_vector_dedup,
        "op11_vector_codes": op11_vector_codes,
        "op12_infill": op12_infill,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict:
    return {"op6_line_dedup": OP6_SQL, "op9_warc": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_infill": OP12_SQL}
