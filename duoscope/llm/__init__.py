"""Operators for preparing training text. Nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

from duoscope.llm.registry import REGISTRY

for _name in ("token_blocks", "langid", "line_chunks", "decontaminate", "near_dup", "exact_dup", "token_counts", "mixing", "suffix_dedup", "licenses",
              "whitening", "collocations", "warc"):
    import_module(f"duoscope.llm.{_name}")

__all__ = ["REGISTRY"]
