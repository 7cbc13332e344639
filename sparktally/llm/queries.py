"""Registry of the training-data queries: one opN_<name> per operator."""

from __future__ import annotations

import importlib

#: query name -> (module, function, name of its DuckDB SQL or None)
_REGISTRY = {
    "op1_lm_score": ("lm_score", "op1_lm_score", "SQL1"),
    "op10_line_dedup": ("line_dedup", "op10_line_dedup", "SQL10"),
    "op2_token_counts": ("token_counts", "op2_token_counts", None),
    "op3_packing": ("packing", "op3_packing", None),
    "op4_decontaminate": ("decontaminate", "op4_decontaminate", "SQL4"),
    "op5_warc": ("warc", "op5_warc", "SQL5"),
    "op6_toxicity": ("toxicity", "op6_toxicity", None),
    "op7_substring_dedup": ("substring_dedup", "op7_substring_dedup", "SQL7"),
    "op8_vp_search": ("vp_search", "op8_vp_search", "SQL8"),
    "op9_jaccard_join": ("jaccard_join", "op9_jaccard_join", "SQL9"),
}


def queries() -> dict:
    return {q: getattr(importlib.import_module(f"{__package__}.{m}"), f) for q, (m, f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(importlib.import_module(f"{__package__}.{m}"), s) for q, (m, _, s) in _REGISTRY.items() if s}
