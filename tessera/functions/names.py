"""Column functions on file names and paths (all JVM-side expressions).

Every function returns a ``Column`` so Catalyst keeps it inside
whole-stage codegen; nothing here runs per row in Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space set used to split a file name into
# parts (tab, LF, VT, FF, CR, space, NEL, NBSP, OGHAM SPACE MARK,
# EN QUAD..HAIR SPACE, LINE SEPARATOR, PARAGRAPH SEPARATOR,
# NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE).
WHITESPACE_CLASS = (r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# The same set as literal characters, for ``translate``.
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")

# ASCII white space other than the space itself.
OTHER_ASCII_SPACE = "\t\n\x0b\x0c\r"

# Default file exclusions of a scan, and the exclusions used
# when a block is built straight from a folder.
DEFAULT_FILE_EXCLUSIONS = ("*.json", "invalid_files", "*.csv", "*.pb")
BLOCK_DIR_EXCLUSIONS = ("rule.json", "invalid_files", "fileblock.csv", "*.pb")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_name(name, delimiters) -> Column:
    """Replace each delimiter in order by a space, then split on runs of
    white space and drop empty parts. ``delimiters`` is an array column."""
    name, delimiters = _col(name), _col(delimiters)
    spaced = F.aggregate(F.coalesce(delimiters, F.array().cast("array<string>")),
                         name, lambda acc, d: F.replace(acc, d, F.lit(" ")))
    return F.filter(F.split(spaced, WHITESPACE_CLASS + "+"), lambda p: p != "")


def split_name_upto(name, delimiters, max_delimiters: int) -> Column:
    """``split_name`` for delimiter lists of at most ``max_delimiters``
    entries, as a chain of built-ins that stays in generated code: the
    replaces are unrolled (an empty or missing delimiter is a no-op) and the
    name is split at single spaces, of which empty parts are dropped. Only names
    with white space other than spaces, or with characters beyond ASCII, pay for
    having every character looked up."""
    name, delimiters = _col(name), _col(delimiters)
    x = name
    for i in range(max_delimiters):
        x = F.replace(x, F.coalesce(F.get(delimiters, i), F.lit("")), F.lit(" "))
    other = reduce(Column.__or__, [name.contains(c) for c in OTHER_ASCII_SPACE], F.octet_length(name) != F.char_length(name))
    plain = F.when(other, F.translate(x, WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))).otherwise(x)
    return F.array_remove(F.split(plain, " "), "")


def parts_key_upto(parts, indexes, max_indexes: int) -> Column:
    """``parts_key`` for index lists of at most ``max_indexes`` entries,
    unrolled: ``get`` is null past either end, ``concat_ws`` skips nulls."""
    if max_indexes <= 0:
        return F.lit("")
    parts, indexes = _col(parts), _col(indexes)
    return F.concat_ws("_", *[F.get(parts, F.get(indexes, j)) for j in range(max_indexes)])


def prefixes_at(path, depths) -> Column:
    """Distinct prefixes of ``path`` cut after the given numbers of ``/``
    separators (``depths``: slash counts + 1). A depth past the end gives
    the whole path."""
    p = _col(path)
    if not depths:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array(*[F.substring_index(p, "/", int(d)) for d in depths]))


def parts_key(parts, indexes) -> Column:
    """Parts at the given 0-based indexes that exist, joined by ``_``.
    Indexes past the end (or negative) are skipped."""
    parts, indexes = _col(parts), _col(indexes)
    picked = F.transform(F.coalesce(indexes, F.array().cast("array<int>")),
                         lambda i: F.when(i >= 0, F.get(parts, i)))
    return F.array_join(F.filter(picked, lambda x: x.isNotNull()), "_")


def file_excluded(name, patterns) -> Column:
    """``*.ext`` excludes any name that contains ``.ext``; any other
    pattern excludes the exact name."""
    name = _col(name)
    conds = [name.contains(p[1:]) if p.startswith("*.") else (name == F.lit(p))
             for p in patterns]
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def folder_excluded(folder_name, exclusions) -> Column:
    """Folders are excluded by exact name only."""
    exclusions = list(exclusions)
    if not exclusions:
        return F.lit(False)
    return _col(folder_name).isin(exclusions)


def base_name(path) -> Column:
    """Last element of a slash path, trailing slashes ignored."""
    return F.regexp_extract(_col(path), r"([^/]+)/*$", 1)


def join_path(folder, name) -> Column:
    return F.concat_ws("/", F.regexp_replace(_col(folder), "/+$", ""), _col(name))


def format_time(ts) -> Column:
    """Seconds-precision text stamp used in listings and file names."""
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def csv_field(value) -> Column:
    """Quote a CSV field the way a standard CSV writer does: empty stays
    empty; quote when it holds a comma, quote, CR or LF, starts with white
    space, or is exactly backslash-dot; quotes inside are doubled."""
    v = _col(value)
    needs = reduce(Column.__or__, [v.contains(c) for c in ',"\r\n']) | F.substring(v, 1, 1).isin(*WHITESPACE_CHARS) | (v == F.lit("\\."))
    return (F.when(v == "", F.lit(""))
            .when(needs, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"')))
            .otherwise(v))


def glob_to_regex(pattern: str) -> str:
    """Translate a shell glob for names inside one folder to an anchored
    regular expression: ``*`` any run of non-separators, ``?`` one
    non-separator, ``[...]`` / ``[^...]`` classes, backslash escapes."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[":
            items, i = _glob_class(pattern, i + 1)
            out.append(items)
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def _glob_class(pattern: str, i: int) -> tuple[str, int]:
    """The class whose items start at ``i``, as a regular expression, and the
    place of its closing bracket. Items are characters, escaped characters and
    ranges; every other sign is taken as itself."""
    def item(i: int) -> tuple[str, int]:
        if i < len(pattern) and pattern[i] == "\\":
            i += 1
        elif i < len(pattern) and pattern[i] in "-]":
            raise ValueError(f"bad glob pattern: {pattern!r}")
        if i >= len(pattern):
            raise ValueError(f"bad glob pattern: {pattern!r}")
        return pattern[i], i + 1

    def plain(c: str) -> str:
        return c if c.isalnum() else f"\\x{{{ord(c):x}}}"

    negated = pattern[i:i + 1] == "^"
    i += negated
    out = []
    while not out or pattern[i:i + 1] != "]":
        low, i = item(i)
        high = low
        if pattern[i:i + 1] == "-":
            high, i = item(i + 1)
        if low <= high:
            out.append(plain(low) if low == high else f"{plain(low)}-{plain(high)}")
        else:
            out.append("")
    body = "".join(out)
    if not body:  # only empty ranges: nothing is in the class
        return ("[^/]" if negated else "(?!)"), i
    return f"[{'^' if negated else ''}{body}]", i


def glob_match(name, pattern: str) -> Column:
    return _col(name).rlike(glob_to_regex(pattern))
