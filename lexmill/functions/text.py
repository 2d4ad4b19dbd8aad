"""Text operators as Column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bound

#: What Python's str.strip() and str.split() take for white space, as a Java class.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"

# The cleaning rules, in their order, as (pattern, replacement).
CLEANING = (
    (r"(?U)-\n(?=\w)", ""),
    (r"(?mdU)^\s*-?\s*\d+\s*-?\s*$", ""),
    (r"(?mdU)^ЧАСТЬ\s+\S+\s*$", ""),
    (r"(?mdU)^Раздел\s+[IVXLCDM]+\.\s*.*$", ""),
    (r"(?mdU)^Глава\s+\d+\.\s*.*$", ""),
    (r"\n{3,}", "\n\n"),
)
#: What a text must hold for a rule to find anything: a substring search spares most texts the pattern.
NEEDED = ("-\n", None, "ЧАСТЬ", "Раздел", "Глава", "\n\n\n")
# Spelled-out forms of common legal abbreviations.
ABBREVIATIONS = ((r"(?U)\bст\.", "статья"), (r"(?U)\bтк\s+рф\b", "трудовой кодекс"), (r"(?U)\bфз\b", "федеральный закон"))
#: What a text must hold for an abbreviation to be found.
ABBREVIATED = ("ст.", "тк", "фз")
# What is taken off a model's answer, a surrounding code fence and Markdown emphasis next to quotes.
FENCE = r"^```[a-zA-Z]*\n?|```\s*$"
EMPHASIS = r'(?<=")[_*]+|[_*]+(?=")'
#: Characters per estimated token.
CHARS_PER_TOKEN = 4
#: Namespace of name-based UUIDs for URLs (RFC 4122).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def strip(col: Column | str) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def _where(text: Column, needed: str, change: Callable[[Column], Column]) -> Column:
    """``change(text)`` of texts that hold ``needed``, the others as they are."""
    return bound(text, lambda t: F.when(F.contains(t, F.lit(needed)), change(t)).otherwise(t))


def clean_text(col: Column | str) -> Column:
    """Line ends unified, broken words joined, page numbers and part headings dropped, blank runs cut."""

    def apply(text: Column, pattern: str, replacement: str, needed: str | None) -> Column:
        change = lambda t: F.regexp_replace(t, pattern, replacement)
        return change(text) if needed is None else _where(text, needed, change)

    text = apply(F.col(col) if isinstance(col, str) else col, "\r\n?", "\n", "\r")
    return strip(functools.reduce(lambda t, rule: apply(t, *rule[0], rule[1]), zip(CLEANING, NEEDED), text))


def normalize_terms(col: Column | str) -> Column:
    text = _where(F.lower(col), "ё", lambda t: F.replace(t, F.lit("ё"), F.lit("е")))
    return functools.reduce(lambda t, rule: _where(t, rule[0], lambda x: F.regexp_replace(x, *rule[1])), zip(ABBREVIATED, ABBREVIATIONS), text)


def tokens(col: Column | str) -> Column:
    return F.regexp_extract_all(normalize_terms(col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def term_id(token: Column | str) -> Column:
    return F.crc32(F.encode(token, "UTF-8"))


def estimated_tokens(col: Column | str) -> Column:
    return F.floor(F.length(col) / CHARS_PER_TOKEN).cast("int")


def parent_id(document_id: Column, section_number: Column) -> Column:
    numbered = section_number.isNotNull() & (section_number != "")
    return F.when(numbered, F.concat_ws(":", document_id, section_number)).otherwise(document_id)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """A version-5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.lower(F.hex((F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def chunk_id(parent: Column, version: Column, number: Column, namespace: str = "chunk") -> Column:
    return uuid5(F.concat_ws(":", F.lit(namespace), parent, version, number.cast("string")))


def embedding_text(title: Column | str, text: Column | str) -> Column:
    return F.concat(F.col(title) if isinstance(title, str) else title, F.lit("\n\n"), F.col(text) if isinstance(text, str) else text)


def strip_code_fence(col: Column | str) -> Column:
    """A model's answer without a surrounding Markdown code fence."""
    return strip(F.regexp_replace(strip(col), FENCE, ""))


def strip_emphasis(col: Column | str) -> Column:
    """JSON without Markdown emphasis next to its quotes."""
    return F.regexp_replace(col, EMPHASIS, "")


def contains_text(columns: list[str], needle: Column | str) -> Column:
    """Case-insensitive substring search in any of several columns; % and _ stand for themselves."""
    find = F.lower(F.lit(needle) if isinstance(needle, str) else needle)
    hits = [F.coalesce(F.contains(F.lower(c), find), F.lit(False)) for c in columns]
    return functools.reduce(lambda a, b: a | b, hits)
