from labelloom.functions.text import (
    ENGLISH_STOP_WORDS,
    clean_text,
    coarse_pos,
    content_tokens,
    join_tokens,
    light_clean,
    min_token_length,
    ngrams,
    null_text_to_empty,
    remove_stopwords,
    tokenize,
    vectorizer_tokens,
)
from labelloom.functions.vectors import argmax, round_metrics, softmax_nll

__all__ = [
    "ENGLISH_STOP_WORDS",
    "argmax",
    "clean_text",
    "coarse_pos",
    "content_tokens",
    "join_tokens",
    "light_clean",
    "min_token_length",
    "ngrams",
    "null_text_to_empty",
    "remove_stopwords",
    "round_metrics",
    "softmax_nll",
    "tokenize",
    "vectorizer_tokens",
]
