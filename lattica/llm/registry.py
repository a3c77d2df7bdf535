"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

import importlib

#: name -> module, function, name of the SQL or None
_OPS = {
    "op1_toxicity": ("toxicity", "op1_toxicity", None),
    "op2_lm": ("attention", "op2_lm", None),
    "op3_secrets": ("secrets", "op3_secrets", None),
    "op4_quality": ("quality", "op4_quality", "OP4_SQL"),
    "op5_mixing": ("mixing", "op5_mixing", None),
    "op6_decontamination": ("decontamination", "op6_decontamination", None),
    "op7_tokens": ("tokenization", "op7_tokens", None),
    "op8_substrings": ("substrings", "op8_substrings", None),
    "op9_jaccard": ("jaccard", "op9_jaccard", "OP9_SQL"),
    "op10_language": ("language", "op10_language", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"lattica.llm.{m}"), f) for name, (m, f, _) in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"lattica.llm.{m}"), s) for name, (m, _, s) in _OPS.items() if s}
