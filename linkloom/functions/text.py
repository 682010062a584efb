"""Tokens, hashes and rounding as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never become tags. Tokens are lowercased before the
# exact match, so the capital "I" never matches and "i" survives.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "I",
    "it", "for", "not", "on", "with", "he", "as", "you", "do", "at",
    "this", "but", "his", "by", "from", "they", "we", "say", "her", "she",
    "or", "an", "will", "my", "one", "all", "would", "there", "their", "what",
    "so", "up", "out", "if", "about", "who", "get", "which", "go", "me",
    "when", "make", "can", "like", "time", "no", "just", "him", "know", "take",
    "people", "into", "year", "your", "good", "some", "could", "them", "see", "other",
    "than", "then", "now", "look", "only", "come", "its", "over", "think", "also",
    "back", "after", "use", "two", "how", "our", "work", "first", "well", "way",
    "even", "new", "want", "because", "any", "these", "give", "day", "most", "us", "was", "is",
]

# Tokens dropped when they consist of nothing but this mark.
PUNCTUATION = [
    ".", ",", ";", ":", "!", "?", "-", "_", "=", "+", "*", "/", "%", "(", ")", "[", "]", "{", "}",
    "'", '"', "“", "”", "‘", "’", "<", ">", "©", "®", "™", "$", "#", "@", "&", "^", "~", "|", "\\",
    "€", "£", "¥", "•", "¶", "…", "—", "›", "‹", "...", "–",
]

# Unicode White_Space plus the four information separators.
_SPACES = r"(?U)[\x1c-\x1f\s]+"


def strip(text: Column) -> Column:
    """Trim whitespace of any kind from both ends."""
    return F.regexp_replace(text, rf"^{_SPACES}|{_SPACES}\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return text.isNull() | ~text.rlike(r"(?U)[^\x1c-\x1f\s]")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), _SPACES)


def tokens(text: Column) -> Column:
    """Lowercased whitespace-separated words, in order."""
    return F.filter(_words(text), lambda word: word != "")


def clean_tokens(text: Column) -> Column:
    """``tokens`` without stop words and lone punctuation."""
    return F.filter(_words(text), lambda word: ~word.isin(["", *STOP_WORDS, *PUNCTUATION]))


def text_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, as lowercase hex."""
    return F.sha2(text, 256)


def round_half_even(value: Column, decimals: int) -> Column:
    """Round to ``decimals`` places, ties to even."""
    scale = float(10**decimals)
    return F.rint(value * scale) / scale
