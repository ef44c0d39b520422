"""Names, paths and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessaline.errors import InvalidRequest

#: What POSIX classes are in Java's patterns.
POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}",
    "space": r"\t\n\x0B\f\r ", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "word": r"\w", "ascii": r"\p{ASCII}",
}
BLANKS = r"\t\n\f\r "
#: Fixed value: the prefix of pointer fields.
POINTER = "$ptr_"
#: What a safe name replaces, by an underscore and by two.
SEPARATORS, DOTS = r'[/\\:*?"<>|]', r"\.\."


def sanitize(name: Column) -> Column:
    """A name that is safe as a folder: trimmed, `default` if blank, separators and double dots replaced."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(name), SEPARATORS, "_"), DOTS, "__")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("default"))


def path_argument(path: Column, index: int) -> Column:
    """The argument after the endpoint of a request path (0: table, 1: key); null if missing or empty."""
    return F.nullif(F.try_element_at(F.split(F.ltrim(path, F.lit("/")), "/"), F.lit(index + 2)), F.lit(""))


def strip_pointer(name: Column) -> Column:
    return F.regexp_replace(name, r"^\$ptr_", "")


def new_auth_key() -> Column:
    return F.uuid()


def java_pattern(pattern: str) -> str:
    """A linear-time pattern (RE2 syntax) as Java understands it; lookaround and back references are refused.

    A dot leaves out the line feed only, $ is the very end (before any line feed with the flag m), and white space
    has no vertical tab.
    """
    if re.search(r"\(\?(=|!|<=|<!|>)", pattern) or re.search(r"(?<!\\)(\\\\)*\\[1-9k]", pattern):
        raise InvalidRequest("lookaround and back references aren't supported")
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "a", re.sub(r"\\z", "", pattern).replace("[:", "").replace(":]", "")))
    except re.error as e:
        raise InvalidRequest(f"bad pattern: {e}") from e
    lines = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out, i, inside, dots = [], 0, False, lines
    while i < len(pattern):
        named = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i) if inside else None
        if named:
            found = _posix(named[2], bool(named[1]))
            i = named.end()
        elif pattern[i] == "\\":
            found = pattern[i : i + 2]
            if found in (r"\s", r"\S"):
                found = {r"\s": BLANKS if inside else f"[{BLANKS}]", r"\S": f"[^{BLANKS}]"}[found]
            i += 2
        else:
            found = pattern[i]
            if not inside and found == "[":
                inside = True
                if pattern[i + 1 : i + 2] == "^":
                    found, i = "[^", i + 1
                if pattern[i + 1 : i + 2] == "]":
                    found, i = found + r"\]", i + 1
            elif inside and found == "]":
                inside = False
            elif inside and found in "[&":
                found = "\\" + found
            elif not inside and found == "$" and not lines:
                found = r"\z"
            elif not inside and found == ".":
                dots = True
            elif not inside and pattern.startswith("(?P<", i):
                found, i = "(?<", i + 3
            i += 1
        out.append(found)
    return "(?d)" * dots + "".join(out)


def _posix(name: str, negated: bool) -> str:
    if name not in POSIX:
        raise InvalidRequest(f"unknown class {name}")
    out = POSIX[name]
    if not negated:
        return out
    return r"\S&&[^\x0B]" if name == "space" else out[:1] + out[1].upper() + out[2:]


def literal_prefix(pattern: str) -> str:
    """The letters that every match of an anchored pattern begins with; it can be pushed to the scan."""
    if not pattern.startswith("^") or "|" in pattern:
        return ""
    m = re.match(r"[A-Za-z0-9_#@ -]*", pattern[1:])
    rest = pattern[1 + m.end() :]
    return m[0][:-1] if rest[:1] in ("*", "?", "{") else m[0]
