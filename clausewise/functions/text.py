"""Scalar text expressions (N1-N8 and the splitting regexes).

All are built-in Column expressions: they run inside whole-stage codegen, need
no shuffle and no Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.constants import REPLACEMENT_RULES

# Python's Unicode ``\w`` is letters, numbers and underscore; spelled out so
# that the Java engine means the same thing.
WORD_CHAR = r"[\p{L}\p{N}_]"
# Sentence boundary: whitespace run after ., ! or ? (lookbehind keeps the mark).
SENTENCE_BREAK = r"(?<=[.!?])[ \t\n\r\f]+"
# Keyword tokens for topic words: runs of two or more word characters.
KEYWORD_TOKEN = WORD_CHAR + "{2,}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_initial_dots(c: Column | str) -> Column:
    """``A.B.`` -> ``AB`` (capital letter followed by a dot loses the dot)."""
    return F.regexp_replace(_col(c), r"([A-Z])\.", "$1")


def apply_replacements(c: Column | str, rules: Sequence[tuple[str, str]] = REPLACEMENT_RULES) -> Column:
    """Ordered literal substring replacements (each rule sees the previous result)."""
    out = _col(c)
    for old, new in rules:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def strip_single_letter_dots(c: Column | str) -> Column:
    """A one-letter word followed by a dot loses the dot (``o.a.`` -> ``oa``).

    The lookbehind inspects the original string, so consecutive abbreviations
    are all handled in one pass.
    """
    return F.regexp_replace(_col(c), r"(?<!" + WORD_CHAR + r")([a-z])\.", "$1")


def replace_nbsp(c: Column | str) -> Column:
    """Non-breaking space -> space."""
    return F.replace(_col(c), F.lit("\u00a0"), F.lit(" "))


def normalize_text(c: Column | str, rules: Sequence[tuple[str, str]] = REPLACEMENT_RULES) -> Column:
    """N1 -> lowercase (N2) -> N3 -> N4 -> N5, as one expression."""
    return replace_nbsp(strip_single_letter_dots(apply_replacements(F.lower(strip_initial_dots(c)), rules)))


def remove_words(c: Column | str, words: Iterable[str]) -> Column:
    """Split on single spaces, drop exact tokens, join again with single spaces."""
    banned = F.array(*[F.lit(w) for w in words])
    return F.array_join(F.filter(F.split(_col(c), " ", -1), lambda x: ~F.array_contains(banned, x)), " ")


def strip_spaces(c: Column | str) -> Column:
    """Strip spaces only (not tabs or newlines)."""
    return F.trim(_col(c))


def sentences(c: Column | str) -> Column:
    """G1: array of sentences (split after ., !, ? followed by whitespace)."""
    return F.split(_col(c), SENTENCE_BREAK, -1)


def comma_parts(c: Column | str) -> Column:
    """Comma parts, stripped of spaces, empty ones dropped (they take no number)."""
    return F.filter(F.transform(F.split(_col(c), ",", -1), lambda x: F.trim(x)), lambda x: x != F.lit(""))


def word_list(c: Column | str) -> Column:
    """Words of a clause: split on single spaces, empty strings dropped."""
    return F.filter(F.split(_col(c), " ", -1), lambda x: x != F.lit(""))


def lexicon_regex(words: Iterable[str]) -> str:
    """Whole-word alternation; a word ends where no word character follows (accented letters and digits are such)."""
    import re
    alt = "|".join(re.escape(w) for w in words)
    edge = WORD_CHAR.replace("[", "[^", 1)
    return f"(^|{edge})({alt})({edge}|$)"


def keyword_tokens(c: Column | str) -> Column:
    """Lowercased keyword tokens (two or more word characters)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(KEYWORD_TOKEN), 0)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` looks into it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
