"""Column-expression builders (JVM-side, codegen friendly)."""

from labelscope.functions.text import (normalize_text, word_count, tokens, ngrams,
                                       STOP_WORDS_EN, TOKEN_PATTERN)
from labelscope.functions.vector import (dot, l2_norm, unit_norm, sq_dist, euclid,
                                         as_double_array)

__all__ = ["normalize_text", "word_count", "tokens", "ngrams", "STOP_WORDS_EN",
           "TOKEN_PATTERN", "dot", "l2_norm", "unit_norm", "sq_dist", "euclid",
           "as_double_array"]
