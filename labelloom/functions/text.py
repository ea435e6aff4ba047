"""String and token functions: plain ``Column -> Column``, no Python workers.

Everything here is row-local, so it can run on a batch frame or on a stream
and never causes a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# --- Fixed values -----------------------------------------------------------
# Character classes that follow Python's str regexes; Java's own \s and \w are
# ASCII-only, so the classes are spelled out.
SPACE = r"\p{Z}\t-\r\x1c-\x1f\x85"
WORD = r"\p{L}\p{N}_"

# Patterns of the heavy cleaner (bag-of-words models).
URL_LOOSE = rf"http[^{SPACE}]+|www\.[^{SPACE}]+"
MENTION = rf"@[{WORD}]+"
NOT_A_LETTER = r"[^a-z]+"

# Patterns of the light cleaner (models that read the sentence).
URL_STRICT = rf"https?://[^{SPACE}]+"
HASH_SIGN = r"#"
SPACES = rf"[{SPACE}]+"

# A word of the vectorizer: two word characters or more.
VECTORIZER_WORD = rf"[{WORD}]{{2,}}"

# Words the usual English word tokenizer splits in two.
FUSED_WORDS = r"\b(can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na\b))"

# The usual English stop-word list. Entries with an apostrophe never match
# cleaned text, which holds letters only; they are kept so that the list also
# serves text that was not cleaned.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its "
    "itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren "
    "aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
# ----------------------------------------------------------------------------


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def null_text_to_empty(text: Column | str) -> Column:
    """Null text becomes the empty string."""
    return F.coalesce(_col(text), F.lit(""))


def clean_text(text: Column | str) -> Column:
    """Lower-case words ``a-z`` separated by single spaces; null gives ``""``.

    Links and mentions vanish whole. Everything else that is not a letter,
    white space and ``#`` included, ends up as one separating space, so those
    steps are a single pass.
    """
    lowered = F.lower(null_text_to_empty(text))
    no_links = F.regexp_replace(lowered, URL_LOOSE, " ")
    no_mentions = F.regexp_replace(no_links, MENTION, " ")
    return F.trim(F.regexp_replace(no_mentions, NOT_A_LETTER, " "))


def light_clean(text: Column | str) -> Column:
    """Drop ``http(s)://`` links, mentions and ``#``; collapse white space.

    Case and punctuation stay, and removed parts leave nothing behind (not a
    space). Null stays null.
    """
    out = _col(text)
    for pattern in (URL_STRICT, MENTION, HASH_SIGN):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, SPACES, " "))


def tokenize(cleaned: Column | str, split_fused: bool = True) -> Column:
    """Words of a cleaned text; no words for an empty text."""
    text = _col(cleaned)
    words = F.regexp_replace(text, FUSED_WORDS, "$1 ") if split_fused else text
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def remove_stopwords(tokens: Column | str, stop: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Tokens outside a stop list given as plain words.

    The list is a literal set in the plan; a stop list that is itself a table
    goes through ``operators.lookup.remove_stopwords_table``.
    """
    words = list(stop)
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda word: ~word.isin(words))


def min_token_length(tokens: Column | str, length: int = 2) -> Column:
    """Tokens of at least ``length`` characters."""
    return F.filter(_col(tokens), lambda word: F.length(word) >= length)


def content_tokens(
    cleaned: Column | str,
    stop: Iterable[str] = ENGLISH_STOP_WORDS,
    min_length: int = 2,
    split_fused: bool = True,
) -> Column:
    """``tokenize``, ``remove_stopwords`` and ``min_token_length`` in one filter."""
    words = list(stop)

    def keep(word: Column) -> Column:
        long_enough = F.length(word) >= min_length
        return long_enough & ~word.isin(words) if words else long_enough

    return F.filter(tokenize(cleaned, split_fused), keep)


def join_tokens(tokens: Column | str) -> Column:
    """Tokens joined by single spaces; ``""`` when there are none."""
    return F.array_join(F.coalesce(_col(tokens), F.array().cast("array<string>")), " ")


def vectorizer_tokens(text: Column | str) -> Column:
    """Lower-cased words of two or more word characters (letters, digits, ``_``), the unit of the vectorizer.

    No words for a null text.
    """
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(VECTORIZER_WORD), F.lit(0))


def ngrams(tokens: Column | str, low: int = 1, high: int = 2) -> Column:
    """All n-grams of the tokens for n from ``low`` to ``high``, in one array.

    Pass a column name (or a plain column): the tokens are used several times.
    """
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    words = _col(tokens)
    grams, wanted = words, [words] if low == 1 else []
    for n in range(2, high + 1):
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), count),
            F.slice(words, F.lit(n), count),
            lambda head, tail: F.concat_ws(" ", head, tail),
        )
        if n >= low:
            wanted.append(grams)
    return F.concat(*wanted) if len(wanted) > 1 else wanted[0]


def coarse_pos(tag: Column | str) -> Column:
    """Fine part-of-speech tag to one of ``a v n r``; anything else is a noun."""
    first = F.substring(_col(tag), 1, 1)
    return F.when(first == "J", "a").when(first == "V", "v").when(first == "R", "r").otherwise("n")
