"""Column expressions for ids, paths, sets and row hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed from ids: the ASCII kinds.
BLANK = " \t\n\r\f\x0b"


def norm_id(c: Column | str) -> Column:
    """An id or path as it compares: without white space around it, backslashes as slashes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.trim(c, F.lit(BLANK)), "\\", "/")


def slice_key(domain: Column, kind: Column, ident: Column) -> Column:
    """``domain/type/id``; null if a part is null."""
    return F.concat(norm_id(domain), F.lit("/"), norm_id(kind), F.lit("/"), norm_id(ident))


def marked(c: Column) -> Column:
    """A string that differs for null and for every value, as hashes skip nulls."""
    return F.coalesce(F.concat(F.lit("V"), c.cast("string")), F.lit("N"))


def set_hash(c: Column, norm=lambda x: x) -> Column:
    """Hash of an array as a set; null counts as the empty set."""
    items = F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: marked(norm(x)))))
    return F.xxhash64(F.size(items), items)


def canonical_json(c: Column) -> Column:
    """JSON text without regard to key order, layout, escapes or the notation of numbers.

    VARIANT stores keys sorted and numbers by value. Text that is no JSON (or repeats a key)
    stands for itself, marked so that it equals no JSON value.
    """
    return F.coalesce(F.to_json(F.try_parse_json(c)), F.concat(F.lit("\x00"), c))


def row_hash(*parts: Column) -> Column:
    """64-bit hash of scalars in which null is a value of its own."""
    return F.xxhash64(*[marked(p) for p in parts])
