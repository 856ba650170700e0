"""Column functions for titles and query strings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is an ASCII letter plus
    combining marks, mapped to that letter.

    Built from the Unicode database by rule (no hand-written list): this is
    what a decompose-and-strip-marks ``strip_accents`` does to Latin text.
    Letters without such a decomposition (for example the sharp s or o with
    stroke) are left alone and later act as token separators.
    """
    src, dst = [], []
    # Latin blocks, and the letter-like signs (Kelvin, Angstrom)
    for block in ((0x00C0, 0x0250), (0x1E00, 0x1F00), (0x2100, 0x2150)):
        for cp in range(*block):
            ch = chr(cp)
            base = "".join(c for c in unicodedata.normalize("NFD", ch)
                           if not unicodedata.combining(c))
            if len(base) == 1 and base.isascii() and base.isalpha() and base != ch:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()

# Token pattern of the title index: maximal runs of ASCII letters after
# accent stripping and lower-casing.
TOKEN_PATTERN = "[a-z]+"


def strip_accents(col: Column) -> Column:
    """Letters without their accents, composed or followed by combining marks."""
    return F.translate(F.regexp_replace(col, r"\p{Mn}+", ""), ACCENTED, UNACCENTED)


def tokens(col: Column) -> Column:
    """``lower(strip_accents(s))`` split into ``[a-z]+`` runs (JVM-side)."""
    return F.regexp_extract_all(F.lower(strip_accents(col)), F.lit(TOKEN_PATTERN), 0)


def py_strip(col: Column) -> Column:
    """trim leading / trailing whitespace like Python's ``str.strip``
    (tabs, newlines, no-break and ideographic spaces too)."""
    # fixed values: what str.strip() takes for whitespace beyond the Unicode property
    space = r"[\p{IsWhite_Space}\x1c-\x1f]+"
    return F.regexp_replace(col, rf"\A{space}|{space}\z", "")


def is_doi_like(q: Column) -> Column:
    """The query contains ``10.`` and ``/``."""
    return q.contains("10.") & q.contains("/")


MIN_QUERY_CHARS = 3


def is_valid_query(q: Column, min_chars: int = MIN_QUERY_CHARS) -> Column:
    """At least ``min_chars`` characters (code points)."""
    return q.isNotNull() & (F.char_length(q) >= min_chars)


def like_pattern(q: Column) -> Column:
    """F8 with wildcards: the user text becomes an ILIKE pattern as is, with
    ``%`` and ``_`` acting as wildcards. Spark treats ``\\`` as the escape
    character, so backslashes in user text are doubled to stay literal."""
    return F.regexp_replace(q, r"\\", r"\\\\")
