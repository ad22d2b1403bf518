"""One query per operator on the given tables, each with the SQL that checks it where one exists."""

from __future__ import annotations

from importlib import import_module

from duoscope.queries.registry import REGISTRY

for _name in ("files", "encoding", "relational", "splitting", "node_tables", "learning"):
    import_module(f"duoscope.queries.{_name}")

__all__ = ["REGISTRY"]
