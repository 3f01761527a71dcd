"""Query text to operator: compilation, routing and budgets. Text only; no data is read here."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: class: (signal, hops, node budget, direction); the order breaks ties.
CLASSES: dict[str, tuple[str, int, int, str]] = {
    "reverse_lookup": (r"\b(callers?|who calls|what calls|used by)\b", 1, 80, "in"),
    "affected_tests": (r"\btests?\b", 2, 60, "both"),
    "blast_radius": (r"\b(impact|affect(s|ed)?|blast|break(s|ing)?)\b", 2, 80, "both"),
    "multi_hop_path": (r"\b(path|reach(es)?|flows?|between)\b", 2, 80, "both"),
    "subsystem_summary": (r"\b(overview|architecture|subsystem|summar(y|ize))\b", 1, 120, "both"),
    "recent_changes": (r"\b(recent|changed|latest|commit)\b", 1, 40, "in"),
    "direct_lookup": (r"\b(calls|callees?|uses|defines?|where)\b", 1, 80, "out"),
}
FALLBACK = ("unknown", 2, 120, "both")
#: Java's own \b takes letters beyond ASCII for parts of words, so that "testö" would hold no "test"; SQL's is of ASCII.
EDGE_OF_WORD = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def bulk(df: DataFrame, column: str) -> DataFrame:
    """Adds the query class of a text column: the most signals win, earlier classes on ties."""
    text = F.lower(F.translate(F.coalesce(F.col(column), F.lit("")), "İ", "I"))  # SQL lowers it to one letter
    scores = [F.struct(F.least(F.size(F.regexp_extract_all(text, F.lit(s.replace(r"\b", EDGE_OF_WORD)), F.lit(0))), F.lit(3)).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, (s, *_)) in enumerate(CLASSES.items())]
    best: Column = F.greatest(*scores)
    return df.withColumn("route", F.when(best["s"] > 0, best["c"]).otherwise(FALLBACK[0]))


@dataclass(frozen=True)
class Plan:
    operator: str  # context, relations, select, search or status
    query_class: str
    hops: int
    budget: int
    direction: str
    target: str | None = None


def compile_query(text: str) -> Plan:
    """A read-only plan of a question."""
    low = (text or "").replace("İ", "I").lower()
    hits = {c: min(3, len(re.findall(s, low, re.ASCII))) for c, (s, *_) in CLASSES.items()}
    chosen = max(hits, key=hits.get)
    name, hops, budget, direction = (chosen, *CLASSES[chosen][1:]) if hits[chosen] else FALLBACK
    target = re.search(r"[`'\"]([^`'\"]+)[`'\"]", text or "")
    if re.search(r"\bstatus\b", low):
        operator = "status"
    elif re.search(r"\b(list|count|how many|which)\b", low):
        operator = "select"
    elif target and name in ("reverse_lookup", "direct_lookup"):
        operator = "relations"
    else:
        operator = "context" if hits[chosen] else "search"
    return Plan(operator, name, hops, budget, direction, target.group(1) if target else None)


def facts_per_node(nodes: int, most: int = 5) -> int:
    return max(1, min(most, round(5 / max(nodes, 1) ** 0.5)))
