"""Queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from docweave.llm.decontam import op5_decontaminate
from docweave.llm.forced_bpe import op9_encode
from docweave.llm.interp_lm import op10_score
from docweave.llm.licenses import op4_licenses
from docweave.llm.near_dup import op6_near_dup
from docweave.llm.oracles import ORACLES
from docweave.llm.phrases import op8_phrases
from docweave.llm.pii import op7_private
from docweave.llm.quality import op2_quality
from docweave.llm.quotes import op3_quotes
from docweave.llm.secret_scan import op1_secrets

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_quotes": op3_quotes,
    "op4_licenses": op4_licenses,
    "op5_decontaminate": op5_decontaminate,
    "op6_near_dup": op6_near_dup,
    "op7_private": op7_private,
    "op8_phrases": op8_phrases,
    "op9_encode": op9_encode,
    "op10_score": op10_score,
    "pipeline": corpus_pipeline.run,
}

__all__ = ["ORACLES", "QUERIES"]
