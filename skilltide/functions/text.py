"""Lexemes, tokens and case-insensitive matching."""

from pyspark.sql import Column, functions as F

from .fixed import LEXEME_DELIMITER, LEXEME_PATTERN, STOP_WORDS


def extract_lexemes(text: Column, max_lexemes: int | None = None) -> Column:
    """Lower-cased words of a text without surrounding punctuation, in order.

    With ``max_lexemes`` only the last so many words are looked at (a search box setting); the
    count is taken before blanks are dropped. A trailing delimiter adds no word.
    """
    trimmed = F.regexp_replace(F.lower(text), LEXEME_DELIMITER + "$", "")
    words = F.split(trimmed, LEXEME_DELIMITER)
    if max_lexemes is not None:
        words = F.slice(
            words, F.greatest(F.lit(1), F.size(words) - max_lexemes + 1), F.lit(max_lexemes)
        )
    stripped = F.transform(words, lambda w: F.regexp_extract(w, LEXEME_PATTERN, 2))
    return F.filter(stripped, lambda w: w != "")


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(STOP_WORDS)


def text_tokens(text: Column) -> Column:
    """Distinct search tokens: whole lower-cased words and their parts between ``-``, ``_``, ``.``;
    stop words are left out."""
    # split by one plain character: a pattern would be compiled for every value
    words = F.split(F.regexp_replace(F.lower(text), r"\s+", " "), " ")
    parts = F.flatten(F.transform(words, lambda w: F.split(F.translate(w, "_.", "--"), "-")))
    return F.filter(
        F.array_distinct(F.concat(words, parts)), lambda t: (t != "") & ~t.isin(STOP_WORDS)
    )


def text_words(text: Column) -> Column:
    """The same tokens with repeats."""
    words = F.split(F.lower(text), r"\s+")
    whole = F.filter(words, lambda w: ~w.rlike("[-_.]"))
    parts = F.flatten(F.transform(
        F.filter(words, lambda w: w.rlike("[-_.]")),
        lambda w: F.concat(F.array(w), F.split(w, "[-_.]"))))
    return F.filter(F.concat(whole, parts), lambda t: (t != "") & ~t.isin(STOP_WORDS))


def match_any(document_tokens: Column, query_tokens: Column) -> Column:
    """At least one query token is a document token."""
    return F.arrays_overlap(document_tokens, query_tokens)


def match_all_prefix(document_tokens: Column, query_tokens: Column) -> Column:
    """Every query token is a prefix of some document token."""
    return F.forall(
        query_tokens,
        lambda q: F.exists(document_tokens, lambda t: F.startswith(t, q)),
    )


def ilike_any(value: Column, patterns: Column, escape: bool = False) -> Column:
    """Case-insensitive match against a list. List items are LIKE patterns unless ``escape``."""
    if escape:
        return F.exists(patterns, lambda p: F.lower(value) == F.lower(p))
    return F.exists(patterns, lambda p: F.ilike(value, p))


def prefix_match(value: Column, prefix: Column, escape: bool = False) -> Column:
    """Case-insensitive prefix test; ``_`` and ``%`` in the prefix are live unless ``escape``."""
    if escape:
        return F.startswith(F.lower(value), F.lower(prefix))
    return F.ilike(value, F.concat(prefix, F.lit("%")))


def literal_prefix(pattern: Column) -> Column:
    """Part of a LIKE pattern before its first wildcard."""
    return F.regexp_extract(pattern, r"^([^%_]*)", 1)


def has_wildcard(pattern: Column) -> Column:
    return F.contains(pattern, F.lit("%")) | F.contains(pattern, F.lit("_"))


def complete(prefix_words: Column, suggestion: Column) -> Column:
    """Words typed so far plus the suggested last word."""
    return F.concat_ws(" ", prefix_words, suggestion)


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))
