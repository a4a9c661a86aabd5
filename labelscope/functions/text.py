"""Text expressions.

Python's ``\\s`` / ``\\w`` are Unicode-aware while Java's are ASCII by default,
so patterns here use explicit Unicode classes.  A word token is a maximal run
of at least two letters, digits or underscores, i.e. the default word pattern
of the usual TF-IDF vectoriser written with Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscope.functions.stopwords import STOP_WORDS_EN

# --- fixed values: Unicode whitespace as Python's str.split() sees it ---
# (ASCII controls 9-13 and 28-31, space, NEL, NBSP, ogham space, the
# U+2000-U+200A spaces, line / paragraph separators, narrow NBSP, medium
# mathematical space, ideographic space).  The same text works in Java and RE2.
WHITESPACE = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_text(col) -> Column:
    """null -> '', lower case, collapse whitespace runs to one space, strip."""
    c = F.lower(F.coalesce(_c(col), F.lit("")))
    return F.trim(F.regexp_replace(c, WHITESPACE, " "))


def word_count(col) -> Column:
    """Number of whitespace-separated words; '' and null give 0."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), WHITESPACE)
    return F.size(F.filter(parts, lambda x: x != F.lit(""))).cast("int")


def tokens(col, stop_words=STOP_WORDS_EN) -> Column:
    """Lower-cased word tokens of length >= 2, stop words removed (array)."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))),
                                F.lit(TOKEN_PATTERN), 0)
    if stop_words:
        # IN over literals becomes a hash-set lookup (OptimizeIn -> InSet)
        stop = sorted(set(stop_words))
        toks = F.filter(toks, lambda t: ~t.isin(stop))
    return toks


def ngrams(tok_col) -> Column:
    """Unigrams followed by adjacent bigrams ('a b') of a token array."""
    t = _c(tok_col)
    n = F.size(t)
    head = F.slice(t, 1, F.greatest(n - 1, F.lit(0)))
    tail = F.slice(t, 2, F.greatest(n - 1, F.lit(0)))
    bigrams = F.zip_with(head, tail, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(t, bigrams)
