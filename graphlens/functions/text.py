"""Column expressions for names, labels, hashes and patterns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters of a token, as estimates of context size count them.
CHARS_PER_TOKEN = 4


def slug(c: Column) -> Column:
    """Lower case; runs of other characters than letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def token_estimate(c: Column) -> Column:
    """Tokens of a text by its length; null for null."""
    return F.ceil(F.length(c) / CHARS_PER_TOKEN).cast("int")


def djb2(c: Column) -> Column:
    """32-bit hash by h * 33 + code, from 5381 on, as eight hexadecimal digits."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    folded = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(5381).cast("long"), lambda h, x: (h * 33 + x).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def title(c: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def shortened(c: Column, longest: int = 40) -> Column:
    """A label of at most ``longest`` characters, cut ones ending in three dots."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 3), F.lit("..."))).otherwise(c)


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ``**/`` any folders, ``*`` and ``?`` within a name, ``{a,b}`` one of some."""
    out, depth = "", 0
    for token in re.findall(r"\*\*/|\*\*|.", glob, re.S):
        if token in ("**/", "**"):
            out += "(?:.*/)?" if token == "**/" else ".*"
        elif token in "*?":
            out += "[^/]*" if token == "*" else "[^/]"
        elif token == "{":
            out, depth = out + "(?:", depth + 1
        elif token == "}" and depth:
            out, depth = out + ")", depth - 1
        elif token == "," and depth:
            out += "|"
        else:
            out += re.escape(token)
    return f"^{out}$"


def canonical(value, sort_arrays: bool = False) -> str:
    """JSON text with sorted keys; null members are left out. ``sort_arrays``: arrays are sets, in the order of their texts."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(v[k]) for k in sorted(v) if v[k] is not None}
        if isinstance(v, (list, tuple)):
            items = [plain(x) for x in v]
            return sorted(items, key=lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))) if sort_arrays else items
        return v

    return json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False)
