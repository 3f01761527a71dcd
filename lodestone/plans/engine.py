"""One read-only entry over a graph: question to DataFrame."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import iterative, relational
from lodestone.plans import criteria
from lodestone.plans.router import compile_query
from lodestone.sources.tables import Graph


def query(g: Graph, text: str) -> DataFrame:
    """Runs the plan that a question compiles to; context returns the nodes around the named target."""
    plan = compile_query(text)
    live = g.live
    if plan.operator == "status":
        return relational.shape(live)
    if plan.operator == "select":
        # the question's own predicate, or an error: never another question's answer
        where = re.search(r"\bwhere\b.*\Z", text, re.I | re.S)
        mode = "count" if re.search(r"\b(count|how many)\b", text, re.I) else "select"
        kinds = [k for k in ("function", "method", "class") if re.search(rf"\b{k}(s|es)?\b", text, re.I)]
        if not where and not kinds:
            raise criteria.UnsupportedClause(f"no predicate in {text!r}")
        asked = criteria.parse(where[0]) if where else criteria.Criteria()
        return criteria.run(live, replace(asked, kinds=tuple(kinds)) if kinds and not where else asked, mode)
    if plan.operator == "relations":
        return relational.relations(live, plan.target, "in" if plan.direction == "in" else "out", limit=plan.budget)
    if plan.target is None:
        words = [w for w in text.lower().split() if len(w) > 2]
        hit = F.array_size(F.array_intersect(F.split(F.lower("label"), "[^a-z0-9]+"), F.lit(words)))
        return live.nodes.withColumn("score", hit).filter("score > 0").orderBy(F.desc("score"), "path", "label").limit(plan.budget)
    near = iterative.reach(live.edges, [plan.target], plan.hops, live.incoming).orderBy("hop", "id").limit(plan.budget)
    return near.join(live.nodes, "id")
