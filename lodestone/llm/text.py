"""The word definition shared by the text operators: runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular expression class and as plain characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def words(column: Column) -> Column:
    """Array of the words of a text; an empty array for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes of a text with A-Z lowered and nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)
