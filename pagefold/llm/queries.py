"""Imports every operator module so that its query registers."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_toxicity", "op2_pii", "op3_simhash", "op4_html", "op5_urls", "op6_packing", "op7_decontaminate",
           "op8_quality", "op9_tokens", "op10_chat", "op11_whitening", "op12_suffix_dedup", "op13_centroids"]

for _m in MODULES:
    import_module(f"pagefold.llm.{_m}")
