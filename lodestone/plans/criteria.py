"""A small language of predicates over nodes, parsed to columns.

clauses joined by `and`; fields and operators:
kind = K, kind in [a, b]; path or crate contains S, != S, excludes S; label contains S, label in [a, b];
callers and production_callers with = != > >= < <=; include_tests = BOOL; limits are given apart.
Whatever else is written raises, so that no answer is quietly another question's.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.predicates import is_test_path
from lodestone.operators import relational
from lodestone.sources.scratch import spread
from lodestone.sources.tables import Graph, among

KINDS = ("function", "method", "class")
_COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_CLAUSE = re.compile(r"\s*(?P<name>\w+)\s*(?:(?P<word>\b(?:contains|excludes|in)\b)|(?P<sign>!=|>=|<=|=|>|<))\s*(?P<value>.*?)\s*\Z", re.S | re.I)


class UnsupportedClause(ValueError):
    """A clause that the language doesn't have."""


@dataclass(frozen=True)
class Bound:
    """A comparison with a count."""

    sign: str
    value: int

    def __post_init__(self) -> None:
        if self.sign not in _COMPARE:
            raise UnsupportedClause(f"no comparison {self.sign!r}")

    def __call__(self, count: Column) -> Column:
        return _COMPARE[self.sign](count, F.lit(self.value))

    def __str__(self) -> str:
        return f"{self.sign} {self.value}"


@dataclass(frozen=True)
class Criteria:
    kinds: tuple[str, ...] = KINDS
    path_contains: str = ""
    path_excludes: str = ""
    label_contains: str = ""
    labels: tuple[str, ...] = ()
    callers: Bound | None = None
    production_callers: Bound | None = None
    include_tests: bool = True
    limit: int = field(default=200)

    def describe(self) -> str:
        """The predicate in words, as it is applied."""
        said = [f"kind in [{', '.join(self.kinds)}]"]
        for name, how in (("path_contains", "path contains"), ("path_excludes", "path excludes"), ("label_contains", "label contains")):
            if value := getattr(self, name):
                said.append(f"{how} {value}")
        if self.labels:
            said.append(f"label in [{', '.join(self.labels)}]")
        said += [f"{n} {b}" for n in ("callers", "production_callers") if (b := getattr(self, n))]
        return " and ".join(said + ([] if self.include_tests else ["include_tests = false"]))

    def nodes(self) -> Column:
        """The part of the predicate that looks at the node alone."""
        low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        test = F.col("kind").isin(*self.kinds)
        if self.path_contains:
            test &= low("path").contains(self.path_contains.lower())
        if self.path_excludes:
            test &= ~low("path").contains(self.path_excludes.lower())
        if self.label_contains:
            test &= low("label").contains(self.label_contains.lower())
        if self.labels:
            test &= low("label").isin(*self.labels)
        return test if self.include_tests else test & ~is_test_path(F.coalesce(F.col("path"), F.lit("")))


def _listed(value: str) -> tuple[str, ...]:
    inside = value[1:-1] if value[:1] == "[" and value[-1:] == "]" else value
    return tuple(dict.fromkeys(x for x in (part.strip().strip("'\"") for part in inside.split(",")) if x))


def _count(value: str, name: str) -> int:
    if not re.fullmatch(r"[+-]?\d+", value):
        raise UnsupportedClause(f"{name} is compared with a whole number, not {value!r}")
    return int(value)


def parse(text: str, limit: int = 200) -> Criteria:
    """Criteria of an expression; a leading `where` is allowed, an unknown clause raises."""
    body = re.sub(r"\A\s*where\s+", "", text or "", flags=re.I).strip()
    out, kinds = Criteria(limit=limit), []
    for clause in re.split(r"\s+and\s+", body, flags=re.I) if body else []:
        m = _CLAUSE.match(clause)
        if not m:
            raise UnsupportedClause(clause)
        name, sign = m["name"].lower(), (m["word"] or m["sign"]).lower()
        value = m["value"] if sign == "in" else m["value"].strip("'\"")
        match name, sign:
            case ("path" | "crate"), "contains":
                out = replace(out, path_contains=value)
            case ("path" | "crate"), ("!=" | "excludes"):
                out = replace(out, path_excludes=value)
            case "label", "contains":
                out = replace(out, label_contains=value)
            case "label", "in":
                out = replace(out, labels=tuple(dict.fromkeys(x.lower() for x in _listed(value))))
            case "kind", ("=" | "in"):
                kinds += [value] if sign == "=" else _listed(value)
            case ("callers" | "production_callers"), _ if sign in _COMPARE:
                out = replace(out, **{name: Bound(sign, _count(value, name))})
            case "include_tests", "=":
                out = replace(out, include_tests=value.lower() not in ("false", "no", "0"))
            case _:
                raise UnsupportedClause(clause)
    return replace(out, kinds=tuple(dict.fromkeys(kinds))) if kinds else out


def matching(g: Graph, criteria: Criteria) -> DataFrame:
    """All nodes that meet the criteria; callers are counted only where they are asked for, for these nodes only."""
    hits = g.nodes.filter(criteria.nodes())
    if criteria.callers is None and criteria.production_callers is None:
        return hits
    own = among(g.edges.select("source", "target", "type").filter((F.col("source") != F.col("target")) & F.col("type").isin(*relational.CALLS)), "target", hits.select("id"))
    paths = g.nodes.select(F.col("id").alias("source"), is_test_path(F.coalesce("path", F.lit(""))).alias("_test"))
    own = spread(own, "source").join(paths.hint("shuffle_hash"), "source")
    counts = relational.caller_counts(Graph(g.nodes, own.withColumn("source", F.when(F.col("_test"), F.concat(F.lit("test\0"), "source")).otherwise(F.col("source"))).drop("_test")), F.col("source").startswith("test\0"), known=False)
    got = hits.join(counts.withColumnRenamed("target", "id"), "id", "left").na.fill(0, ["callers", "production_callers"])
    for name in ("callers", "production_callers"):
        if bound := getattr(criteria, name):
            got = got.filter(bound(F.col(name)))
    return got.select(g.nodes.columns)


def run(g: Graph, criteria: Criteria, mode: str = "select") -> DataFrame:
    """select: rows, cut to the limit in insertion order and then sorted; count: their number; exists: 1 or 0, after the first hit."""
    hits = matching(g, criteria)
    if mode == "select":
        return hits.orderBy("ord").limit(criteria.limit).orderBy("path", "label", "id")
    if mode == "count":
        return hits.agg(F.count("*").alias("total"))
    if mode == "exists":
        return hits.limit(1).agg(F.count("*").alias("total"))
    raise ValueError(f"no mode {mode!r}")
