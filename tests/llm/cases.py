"""Rows every operator must take, and rows made at random from them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Extra columns bear names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, body string, key string, hash string, c0 int, label int"

SENTENCE = "The quick brown fox jumps over the lazy dog while seven wizards box quietly at noon"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text) with further columns, some of them null."""
    full = [(i, t, None if n % 2 else "en", "s", len(t or ""), "x", None, "h", n, 1) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows() -> list[tuple]:
    long_text = " ".join(f"word{i % 977} other{i % 31}" for i in range(12_000))
    return [
        (1, None), (2, ""), (3, "   \t\n "), (4, SENTENCE), (5, SENTENCE.replace(" ", "  ")), (6, SENTENCE.upper()), (4, SENTENCE), (7, "one"), (8, "one"),
        (9, "One"), (10, long_text), (11, long_text + " tail"), (12, "　  é ñ 日本語 😀 \x00 end"), (None, "no id " + SENTENCE), (13, "a " * 3000), (7, "other text of an id seen before"),
    ]


def edited_rows(seed: int, families: int = 12, size: int = 8) -> list[tuple]:
    """Families of texts that differ by a few words, from one word to a few hundred."""
    rnd, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for f in range(families):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 4, 8, 9, 10, 12, 14, 16, 18, 25, 40, 90, 300]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                at = rnd.randrange(len(own) + 1)
                own[at : at + rnd.choice([0, 1])] = [rnd.choice(words)] * rnd.choice([0, 1])
            rows.append(" ".join(own))
    rnd.shuffle(rows)
    return list(enumerate(rows))
