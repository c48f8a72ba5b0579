"""Text expressions shared by ingest, consolidation and the graph. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of the Unicode White_Space property.
WHITESPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Punctuation dropped from the end of a name.
TRAILING_PUNCTUATION = ".,;:!?"

PAIRED_QUOTES = r"""(?s)\A"(.*)"\z|\A'(.*)'\z"""


def trimmed(c: Column) -> Column:
    """Strip Unicode white space on both ends (plain ``trim`` strips blanks only)."""
    return F.trim(c, F.lit(WHITESPACE))


def lowered(c: Column) -> Column:
    """Character-by-character lower case.

    Dotted capital I and capital sigma are the two characters whose lower case
    is contextual or longer on the JVM; mapping them first keeps positions in
    the lower-cased text equal to positions in the original.
    """
    mapped = F.when(c.contains("İ") | c.contains("Σ"), F.translate(c, "İΣ", "iσ")).otherwise(c)
    return F.lower(mapped)


def content_hash(c: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(c, 256)


def clipped(c: Column, limit: int) -> Column:
    """Trim, then shorten texts of more than ``limit`` bytes, ending in ``...``.

    Of a longer text the most whole characters that leave room for the dots stay.
    """
    t = trimmed(c)
    room = max(limit - 3, 0)
    data = t.cast("binary")

    def whole(size: int) -> Column:
        """Whether a character ends at ``size``: the next byte does not continue one."""
        return ~F.hex(F.substring(data, size + 1, 1)).between("80", "BF")

    # A character has at most four bytes.
    size = F.lit(max(room - 3, 0))
    for n in range(max(room - 2, 0), room + 1):
        size = F.when(whole(n), F.lit(n)).otherwise(size)
    cut = F.substring(data, F.lit(1), size).cast("string")
    return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(cut, F.lit("...")))


def quoted(c: Column) -> Column:
    """Double-quoted with backslash escapes for quotes and control characters."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    # Escape sequences.
    for raw, escaped in (
        ('"', '\\"'),
        ("\n", "\\n"),
        ("\t", "\\t"),
        ("\r", "\\r"),
        ("\a", "\\a"),
        ("\b", "\\b"),
        ("\f", "\\f"),
        ("\v", "\\v"),
    ):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def clean_name(c: Column) -> Column:
    """Trim, drop one pair of matching quotes, drop trailing punctuation, trim.

    The quote step comes first: a quoted name followed by a full stop keeps its quotes.
    """
    bare = F.regexp_replace(trimmed(c), PAIRED_QUOTES, "$1$2")
    return trimmed(F.rtrim(bare, F.lit(TRAILING_PUNCTUATION)))


def sentences(c: Column) -> Column:
    """Array of raw pieces, each ending at ``.``, ``!``, ``?``, a newline or the end of the text."""
    return F.split(c, r"(?<=[.!?\n])")
