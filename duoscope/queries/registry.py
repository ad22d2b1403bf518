"""Where queries register, and a small builder for the checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str, str]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        assert name not in REGISTRY, name
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def view(name: str, text: str, *needs: str, kept: bool = False) -> None:
    """A named subquery of the checking SQL; may be recursive. ``kept``: computed once however often it is used."""
    VIEWS[name] = (needs, text, "AS MATERIALIZED" if kept else "AS")


def sql_of(final: str, *needs: str) -> str:
    """``final`` with the named subqueries it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in VIEWS[name][0]:
                add(n)
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return final
    parts = ",\n".join(f"{n} {VIEWS[n][2]} ({VIEWS[n][1]})" for n in order)
    return f"WITH RECURSIVE {parts}\n{final}"


def renamed_views(prefix: str, last: str, given: set[str], changed: dict[str, str] | None = None) -> str:
    """The views that lead to ``last``, again under ``prefix``, but with views of one's own where ``given`` names them.

    ``changed`` replaces the text of some. Returns the new name of ``last``.
    """
    chain: list[str] = []

    def add(name: str) -> None:
        if name not in given and name not in chain:
            for n in VIEWS[name][0]:
                add(n)
            chain.append(name)

    add(last)
    names = re.compile(r"\b(" + "|".join(sorted([*chain, *given], key=len, reverse=True)) + r")\b(?!\()")

    def own(text: str) -> str:
        return names.sub(lambda m: prefix + m[1], text)

    for name in chain:
        needs, text, how = VIEWS[name]
        text = (changed or {}).get(name, text)
        recursive = re.search(rf"\b{name}\b", text) is not None
        VIEWS[prefix + name] = (tuple(prefix + n for n in needs), own(text), "AS" if recursive else "AS MATERIALIZED")
    return prefix + last
