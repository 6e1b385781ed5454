"""One-hop pattern queries: ``MATCH (a:Kind)-[:EDGE]->(b:Kind) [WHERE a.name = 'x'] RETURN a``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from kelpgraph.model import NODE_KINDS, PropertyGraph
from kelpgraph.operators.graph import match_pattern

_SHAPE = re.compile(
    r"^\s*match\s*\(\s*(?P<a>\w+)\s*:\s*(?P<kind_a>\w+)\s*\)\s*-\s*\[\s*:\s*(?P<edge>\w+)\s*\]\s*->\s*\(\s*(?P<b>\w+)\s*:\s*(?P<kind_b>\w+)\s*\)"
    r"(?:\s*where\s+(?P<var>\w+)\s*\.\s*name\s*=\s*(?P<q>['\"])(?P<value>.*?)(?P=q))?\s*return\s+(?P<out>\w+)\s*;?\s*$",
    re.I | re.S,
)


class PatternError(ValueError):
    """The text is no pattern query that can be answered."""


def node_kind(word: str) -> str:
    """The kind a word names in any case."""
    for kind in NODE_KINDS:
        if kind.lower() == word.lower():
            return kind
    raise PatternError(f"unknown node kind: {word}")


def pattern_query(graph: PropertyGraph, text: str, *, limit: int | None = None) -> DataFrame:
    """The nodes a pattern query returns. Edge kinds are not checked: an unknown one finds nothing.

    Variables must be bound; a name bound on both sides means the left one.
    """
    found = _SHAPE.match(text)
    if not found:
        raise PatternError("expected MATCH (a:Kind)-[:EDGE]->(b:Kind) [WHERE a.name = 'x'] RETURN a")
    sides = {found["b"]: "b"} | {found["a"]: "a"}
    for variable in filter(None, (found["var"], found["out"])):
        if variable not in sides:
            raise PatternError(f"unbound variable: {variable}")
    names = {"name_" + sides[found["var"]]: found["value"]} if found["var"] else {}
    return match_pattern(graph, node_kind(found["kind_a"]), found["edge"].upper(), node_kind(found["kind_b"]), returns=sides[found["out"]], limit=limit, **names)
