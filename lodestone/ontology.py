"""Relation and provenance dimensions of the property graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: relation: (family, strength). A relation that isn't here has DEFAULT_STRENGTH and is weak.
RELATIONS: dict[str, tuple[str, float]] = {
    "calls": ("execution", 1.0), "calls_candidate": ("execution", 0.0), "observed_calls": ("execution", 1.0),
    "imports": ("dependency", 0.95), "imports_from": ("dependency", 0.95), "uses": ("dependency", 0.8),
    "reads": ("dataflow", 0.9), "writes": ("dataflow", 0.9), "data_flow": ("dataflow", 0.9), "tests": ("validation", 0.85),
    "configures": ("configuration", 0.85), "contains": ("hierarchy", 0.7), "implements": ("type", 0.9), "field_of": ("type", 0.8),
    "type_of": ("type", 0.8), "returns": ("type", 0.75), "references": ("mention", 0.7), "fixes": ("history", 0.75),
    "links": ("document", 0.55), "includes": ("document", 0.6), "mentions": ("document", 0.5), "discusses": ("document", 0.65),
    "section_of": ("document", 0.08), "explains": ("document", 0.95), "similar_to": ("similarity", 0.4), "supersedes": ("temporal", 0.8),
    "records": ("temporal", 0.75), "remembers": ("memory", 0.7), "cross_repo": ("federation", 0.65), "control_flow": ("control", 0.85),
    "contradicts": ("logic", 0.9), "supports": ("logic", 0.8), "used_input": ("decision_trace", 0.9), "applied_policy": ("decision_trace", 1.0),
}
WEAK = ("calls_candidate", "references", "links", "includes", "mentions", "discusses", "section_of", "relates")
DEFAULT_STRENGTH = 0.5
PROVENANCE: dict[str, float] = {
    "tree_sitter": 0.95, "tree_sitter_ambiguous_call": 0.35, "regex_import": 0.85, "regex_reference": 0.45, "human": 1.0,
    "imported": 0.75, "extracted": 0.8, "inferred": 0.55, "ambiguous": 0.35, "runtime_trace": 1.0, "episode": 0.9, "memory": 0.9, "federation": 0.75,
}
DEFAULT_PROVENANCE = 0.6


def _lookup(column: str, values: dict[str, float], default: float) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(default))


def strength(column: str = "type") -> Column:
    """Traversal strength of a relation; zero is a wall."""
    return _lookup(column, {k: v for k, (_, v) in RELATIONS.items()}, DEFAULT_STRENGTH)


def trust(column: str = "provenance") -> Column:
    return _lookup(column, PROVENANCE, DEFAULT_PROVENANCE)


def family(column: str = "type") -> Column:
    pairs = [F.lit(x) for k, (f, _) in RELATIONS.items() for x in (k, f)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit("generic"))


def sql_case(column: str, values: dict, default: str) -> str:
    """The same lookup for an oracle."""
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items())
    return f"CASE {column} {arms} ELSE {default} END"
