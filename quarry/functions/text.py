"""Column functions with Python string semantics, built from native Spark
expressions so they stay inside whole-stage codegen.

Each helper takes and returns a ``Column``; none of them ships rows to Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, i.e. the
# separators of str.split() and the characters removed by str.strip().
# Written as a Java / RE2 character-class body.
WS_CLASS = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# The same class without the line feed (whitespace inside one line).
WS_NO_LF_CLASS = (r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

WORD_RE = f"[^{WS_CLASS}]+"
# (?d): only \n ends a line, like str.split('\n'); (?m): ^ at each line start.
HEADER_RE = f"(?md)^[{WS_NO_LF_CLASS}]*#"
SUFFIX_RE = r"(?s)^.+(\.[^.]+)$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_newlines(col) -> Column:
    """Universal newlines: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(_c(col), r"\r\n?", "\n")


# The members of WS_CLASS, listed (for character-table functions).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def word_count(col) -> Column:
    """``len(s.split())`` without materialising the words: every whitespace
    character becomes a space (a character-table ``translate``), space runs
    collapse to one, and each remaining space that is followed by a
    character starts a word (a leading space is prepended)."""
    spaced = F.translate(_c(col), WS_CHARS, " " * len(WS_CHARS))
    c = F.regexp_replace(F.concat(F.lit(" "), spaced), " +", " ")
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return (spaces - F.when(c.endswith(" "), 1).otherwise(0)).cast("bigint")


def line_count(col) -> Column:
    """``len(s.split('\\n'))``: number of line feeds plus one."""
    c = _c(col)
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def header_count(col) -> Column:
    """Lines whose ``strip()`` starts with ``#``."""
    return F.regexp_count(_c(col), F.lit(HEADER_RE)).cast("bigint")


def preview(col, n: int = 500, ellipsis: bool = True) -> Column:
    """``s[:n] + '...'`` when longer than ``n`` code points."""
    c = _c(col)
    head = F.substring(c, 1, n)
    if not ellipsis:
        return head
    from quarry.fixed import ELLIPSIS
    return F.when(F.length(c) > n, F.concat(head, F.lit(ELLIPSIS))).otherwise(head)


def file_name(path) -> Column:
    """Last path component."""
    return F.substring_index(_c(path), "/", -1)


def file_suffix(name) -> Column:
    """``PurePath(name).suffix``: last dot-suffix, not for dot-files."""
    return F.regexp_extract(_c(name), SUFFIX_RE, 1)


def round_half_even(col, digits: int) -> Column:
    """Python's ``round(x, d)`` on doubles (banker's rounding)."""
    return F.bround(_c(col), digits)


def iso_timestamp(col) -> Column:
    """``datetime.isoformat()``: microseconds only when non-zero."""
    c = _c(col)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    frac = F.unix_micros(c.cast("timestamp")) % F.lit(1000000)
    return F.when(frac == 0, whole).otherwise(micros)


def format_fixed(col, digits: int) -> Column:
    """``f'{x:.Nf}'``: round half-even first (Java's %f rounds half-up)."""
    return F.format_string(f"%.{digits}f", F.bround(_c(col), digits))


def format_2f(col) -> Column:
    return format_fixed(col, 2)


def day_span(start, end) -> Column:
    """``(end - start).days``: whole days, floored (negative spans too)."""
    secs = F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return F.floor(secs / F.lit(86_400_000_000)).cast("bigint")


def template(tpl: str, **values) -> Column:
    """A ``{name}`` template (see ``quarry.fixed``) as one ``concat`` of
    literals and columns (numbers are rendered as Python prints them)."""
    parts = re.split(r"\{(\w+)\}", tpl)
    cols = []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            if part:
                cols.append(F.lit(part))
        else:
            v = values[part]
            cols.append((F.lit(v) if not isinstance(v, Column) else v).cast("string"))
    return F.concat(*cols) if cols else F.lit("")
