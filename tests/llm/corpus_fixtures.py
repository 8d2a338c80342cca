"""Awkward rows that all operators must take, and fixtures of them."""

import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 4000
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions in old copper kettles".split()


def sentence(k, n=40):
    """A text of its own for each ``k``."""
    return " ".join(WORDS[(k * k + 3 * i * (k + 1) + i * i) % len(WORDS)] + str((k * 31 + i) % 7) for i in range(n))


ROWS = [
    (1, sentence(1), "en", "a", 10),
    (2, sentence(2), "en", "a", 10),
    (3, sentence(1), "de", "b", 10),
    (3, sentence(1), "de", "b", 10),
    (4, "  " + sentence(1).replace(" ", "\n "), "de", None, None),
    (5, None, None, "b", None),
    (6, "", "fr", "b", 0),
    (7, " \t\r\n\x0b\x0c", "fr", "c", 6),
    (8, LONG, "en", "a", len(LONG)),
    (9, "één zwölf naïve 日本語 テキスト 🙂 <|endoftext|> x", "nl", "c", 40),
    (10, sentence(10) + " tail", "en", "a", 11),
    (11, sentence(10) + " Tail.", "en", "a", 11),
    (None, sentence(12), "en", "a", 11),
    (13, "a", "en", "a", 1),
    (14, "A", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside or return.
CLASHING = (
    "fp", "text_hash", "_text", "_row", "_digest", "_points", "_id", "_hash", "_same", "label", "node", "n", "ids", "length",
    "task", "frame", "size", "checksum", "shard", "slot", "curve", "value", "bin", "blob", "spans", "found", "score", "kept",
    "component_id", "keep_id", "pattern", "gram", "n_tokens", "_salt", "_salts", "_rank", "_best", "item_id",
)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
