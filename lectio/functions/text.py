"""Native text expressions (JVM side, whole-stage codegen friendly).

Every rule here is a regular expression restricted to the features shared by
Java regex and RE2 (``\\p{L}``, classes, no look-around), so an independent SQL
engine can evaluate the very same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
# Token rule (approximation of a Treebank-style word tokenizer): a run of
# letters/digits with optional inner apostrophe parts, else one single
# non-space, non-alphanumeric character.
TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:['’][\p{L}]+)*|[^\s\p{L}\p{N}]"
# Word tokens only (tokens that start with a letter or digit).
WORD_PATTERN = r"[\p{L}\p{N}]+(?:['’][\p{L}]+)*"
# A sentence ends with a run of terminal punctuation.
SENT_END_PATTERN = r"[.!?]+"
# Syllable estimate: groups of vowels in lower-cased text (en/fr/de/es letters).
VOWEL_GROUP_PATTERN = r"[aeiouyàáâäèéêëìíîïòóôöùúûüÿ]+"
# Whitespace-delimited word.
NONSPACE_PATTERN = r"\S+"
# -------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col) -> Column:
    """Array of tokens of a text."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 0)


def word_tokens(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(WORD_PATTERN), 0)


def whitespace_words(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(NONSPACE_PATTERN), 0)


def whitespace_word_count(col) -> Column:
    return F.size(whitespace_words(col)).cast("long")


def tokenized_text(col) -> Column:
    """T1 re-joined with single spaces (the ``-tok`` variant of a text)."""
    return F.array_join(tokens(col), " ")


def truncate_words(col, n: int = 300) -> Column:
    """First ``n`` pieces of ``text.split(' ')`` re-joined with a space."""
    return F.array_join(F.slice(F.split(_c(col), " "), 1, n), " ")


def syllable_count(col) -> Column:
    return F.size(F.regexp_extract_all(F.lower(_c(col)), F.lit(VOWEL_GROUP_PATTERN), 0)).cast("long")


def sentence_count(col) -> Column:
    """Number of terminal punctuation runs, at least one for a non-empty text."""
    return F.greatest(F.size(F.regexp_extract_all(_c(col), F.lit(SENT_END_PATTERN), 0)),
                      F.lit(1)).cast("long")


def file_key(path_col, pattern: str) -> Column:
    """Document key parsed from a file path with one capture group."""
    return F.regexp_extract(_c(path_col), pattern, 1)


def argmax(col) -> Column:
    """0-based index of the first maximum of an array of scores."""
    c = _c(col)
    return (F.array_position(c, F.array_max(c)) - 1).cast("long")


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (ANSI mode would raise)."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, a.cast("double") / b.cast("double"))
