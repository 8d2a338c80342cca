"""Text normalisation, term keys and word n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and the plain letter each folds to, position by position.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"

_SPACE = r"[ \t\r\n\f]+"


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def norm(c: Column) -> Column:
    """Lower case, accents folded, white space collapsed."""
    return collapse_space(F.translate(F.lower(c), ACCENTED, PLAIN))


def term_text(c: Column) -> Column:
    """Text as a space-separated run of term tokens.

    A token is made of letters, digits, ``+``, ``#`` and inner dots, so ``C++``, ``C#`` and
    ``Node.js`` stay whole and a sentence's closing dot does not stick to its last word.
    """
    words = F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "[^a-z0-9+#.]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(words, r"\.+( |$)", " "), " +", " "))


def tokens(c: Column) -> Column:
    """Token array of an already prepared ``term_text``; empty for blank or null text."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), " "), "")


def with_ngrams(df: DataFrame, words: str, sizes: Sequence[int], prefix: str) -> DataFrame:
    """Add one array column ``<prefix><n>`` of n-word runs per size, in text order."""
    for n in sizes:
        df = NGram(n=n, inputCol=words, outputCol=f"{prefix}{n}").transform(df)
    return df


def summarise(c: Column, limit: int) -> Column:
    """Leading text of at most ``limit`` characters, cut after a sentence where one ends."""
    head = F.substring(c, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.length(c) <= limit, c).when(sentence != "", sentence).otherwise(head)
