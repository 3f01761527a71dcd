"""Predicates and projections on node columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Whether a path is one of the scopes or lies below one; backslashes count as slashes."""
    clean = F.regexp_replace(path, r"\\", "/")
    hit = F.lit(not scopes)
    for scope in scopes:
        s = scope.replace("\\", "/").strip("/")
        hit = hit | (clean == s) | clean.startswith(s + "/")
    return hit


def line_of(summary: Column) -> Column:
    """The first L<n> of a summary, one at least; null if there is none."""
    n = F.regexp_extract(summary, r"\bL(\d+)\b", 1).try_cast("int")
    return F.when(n.isNotNull(), F.greatest(F.lit(1), n))


def is_test_path(path: Column) -> Column:
    """Test material by the conventions of paths: a test folder, test_ before or _test behind the name."""
    return F.lower(path).rlike(r"(^|/)(tests?|specs?)(/|$)|(^|/)test_[^/]*$|_test\.[a-z]+$|(test|spec)s?\.(java|kt|ts|js)$")


def term_key(value: Column) -> Column:
    """A key in which case, marks and camel case don't matter."""
    spaced = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(spaced), "[^a-z0-9]+", " "))


def inflections(term: Column) -> Column:
    """The term and its stems without ies, ing, ed, es or s, of three characters or more."""
    def cut(end: str, put: str = "") -> Column:
        return F.when(term.endswith(end), F.concat(term.substr(F.lit(1), F.length(term) - len(end)), F.lit(put)))

    forms = F.array(term, cut("ies", "y"), cut("ing"), cut("ed"), cut("es"), cut("s"))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (F.length(x) >= 3))))


def specificity(term: Column) -> Column:
    return F.tanh((F.length(term) - 5) / 3)


def not_after(left: Column, right: Column) -> Column:
    """left <= right as times where both are ISO times, else as text."""
    a, b = F.try_to_timestamp(left), F.try_to_timestamp(right)
    return F.when(a.isNotNull() & b.isNotNull(), a <= b).otherwise(left <= right)
