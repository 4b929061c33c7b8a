"""Text normalisers used by label matching and search."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query words that block a search, and words that carry no search meaning.
NEGATION_WORDS = (
    "pas", "sans", "aucun", "aucune", "absence", "nicht", "kein", "keine", "keinen", "no", "not", "without",
)
FILLER_WORDS = (
    "je", "j", "ai", "me", "mon", "ma", "mes", "le", "la", "les", "de", "des", "du", "au", "aux", "a", "est", "il", "qui", "quand",
    "ich", "mir", "ist", "beim", "der", "die", "das", "und", "the", "an", "my", "when", "i", "have",
)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Character folding derived from the Unicode tables: case fold, decompose, drop marks."""
    source, target, expansions = [], [], {}
    for point in range(0x80, 0x20000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", char.casefold()) if not unicodedata.combining(c)
        )
        if folded == char or not re.search("[a-z0-9]", folded):
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            expansions[char] = folded
    return "".join(source), "".join(target), expansions


def _ranges(points: list[int]) -> str:
    """Code points as regex character ranges."""
    spans: list[list[int]] = []
    for point in points:
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


def fold(text: Column) -> Column:
    """Lower-case ASCII folding; one-to-many characters only cost anything where they occur."""
    source, target, expansions = _folding()
    lowered = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    simple = F.translate(F.regexp_replace(lowered, r"\p{Mn}+", ""), source, target)
    expansions = {char: plain for char, plain in expansions.items() if char not in "ßẞ"}
    table = F.create_map(*[F.lit(x) for pair in expansions.items() for x in pair])
    # the range test comes first, so plain characters never reach the long class
    rare = r"[\x{80}-\x{1FFFF}&&[" + _ranges(sorted(map(ord, expansions))) + "]]"
    expanded = F.array_join(
        F.transform(F.split(simple, ""), lambda c: F.coalesce(F.element_at(table, c), c)), ""
    )
    return F.when(simple.rlike(rare), expanded).otherwise(simple)


def normalize_label(text: Column) -> Column:
    """Folded ``[a-z0-9]+`` tokens joined by one space."""
    return F.btrim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def normalize_search(text: Column) -> Column:
    """As :func:`normalize_label`, then a plain plural ``s`` is dropped.

    The character before the ``s`` may be a space, exactly as the rule is written.
    """
    return F.regexp_replace(normalize_label(text), r"\b([a-z]{3,}[^s])s\b", "$1")


def tokens(normalized: Column) -> Column:
    """Tokens of a normalised text; an empty text has none."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def query_tokens(normalized: Column) -> Column:
    """Meaningful tokens of a search phrase: empty when a negation word is among them."""
    first = tokens(normalized)
    negation = F.array(*[F.lit(w) for w in NEGATION_WORDS])
    filler = F.array(*[F.lit(w) for w in FILLER_WORDS])
    kept = F.filter(first, lambda t: ~F.array_contains(filler, t) & (F.length(t) >= 2))
    return F.when(F.arrays_overlap(first, negation), F.array().cast("array<string>")).otherwise(kept)


def word_ngrams(words: Column, size: int | Column) -> Column:
    """All runs of ``size`` words."""
    size = F.lit(size)
    last = F.size(words) - size + 1
    return F.when(
        last >= 1,
        F.transform(
            F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, size), " ")
        ),
    ).otherwise(F.array().cast("array<string>"))
