"""Column expressions for text: cleaning, line statistics, formatting, pieces.

All of them are built-in Spark SQL expressions (JVM side, whole-stage codegen);
none calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import PIECE_PATTERN, SHORT_LINE_CHARS

# Characters Python's str.strip() removes: Unicode White_Space plus the four
# information separators U+001C..U+001F.
_WS = r"[\s\x1c-\x1f]"
STRIP = r"(?U)\A" + _WS + r"+|" + _WS + r"+\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Light whitespace normalisation, in this order: CRLF -> LF; NBSP -> space;
    runs of spaces/tabs -> one space; three or more LF -> two LF; strip."""
    t = F.replace(_c(c), F.lit("\r\n"), F.lit("\n"))
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, "\t[ \t]*| [ \t]+", " ")      # a single space stays as it is, so it is no match
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, STRIP, "")


def char_len(c) -> Column:
    """Length in code points (an emoji counts once)."""
    return F.length(_c(c))


def utf8_len(c) -> Column:
    """Encoded UTF-8 byte count."""
    return F.octet_length(_c(c))


def nonblank_lines(c) -> Column:
    """Array of the lines (split on LF) that hold a non-whitespace character."""
    return F.filter(F.split(_c(c), "\n", -1), lambda ln: ln.rlike(r"(?U)[^\s\x1c-\x1f]"))


def line_counts(c) -> tuple[Column, Column]:
    """(non-blank lines, short non-blank lines); short is measured unstripped."""
    lines = nonblank_lines(c)
    return F.size(lines), F.size(F.filter(lines, lambda ln: F.length(ln) < SHORT_LINE_CHARS))


def is_prose(n_lines: Column, n_short: Column) -> Column:
    """short / lines <= 0.5, evaluated in integers; no line means not prose."""
    return (n_lines > 0) & (n_short * 2 <= n_lines)


def format_doc(title, text) -> Column:
    """``= title =`` heading, blank line, body, blank line."""
    return F.concat(F.lit("= "), _c(title), F.lit(" =\n\n"), _c(text), F.lit("\n\n"))


def with_prefix_space(c) -> Column:
    """The pre-tokeniser adds one space unless the input already starts with one."""
    t = _c(c)
    return F.when(F.substring(t, 1, 1) == " ", t).otherwise(F.concat(F.lit(" "), t))


def pieces(c, add_prefix_space: bool = True) -> Column:
    """Pre-token pieces of a text, in order (``regexp_extract_all`` group 0)."""
    t = with_prefix_space(c) if add_prefix_space else _c(c)
    return F.regexp_extract_all(t, F.lit("(?U)" + PIECE_PATTERN), F.lit(0))


def _hex_pairs(c) -> Column:
    """Array of the two-digit hex codes of a string's UTF-8 bytes.

    The hex string is computed once per row; ``split`` on the empty look-behind
    pattern cuts it every two characters (no per-byte recomputation).
    """
    hx = F.hex(F.encode(_c(c), "UTF-8"))
    return F.filter(F.split(hx, "(?<=\\G..)", -1), lambda h: h != "")


def symbol_string(c) -> Column:
    """Byte symbols of a piece as a delimited string: byte b becomes ``|b+1|``.

    This is the state the pair-merge loop rewrites with plain string replaces.
    """
    # One character per byte: its code is the byte.
    chars = F.filter(F.split(F.decode(F.encode(_c(c), "UTF-8"), "ISO-8859-1"), "", -1), lambda x: x != "")
    return F.array_join(F.transform(chars, lambda x: F.concat(F.lit("|"), (F.ascii(x) + 1).cast("string"), F.lit("|"))), "")


def byte_values(c) -> Column:
    """Array of the UTF-8 byte values (0..255) of a string."""
    return F.transform(_hex_pairs(c), lambda h: F.conv(h, 16, 10).cast("int"))


def symbols_of(y) -> Column:
    """Parse a delimited symbol string ``|a||b|`` into ``array<int>``."""
    y = _c(y)
    inner = F.substring(y, 2, F.length(y) - 2)
    return F.transform(F.split(inner, r"\|\|"), lambda s: s.cast("int"))


def whitespace_words(c) -> Column:
    """Number of whitespace-separated words (Python ``str.split()``)."""
    parts = F.split(_c(c), r"(?U)[\s\x1c-\x1f]+")
    return F.size(F.filter(parts, lambda x: x != ""))
