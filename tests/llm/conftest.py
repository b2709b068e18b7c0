"""Odd inputs that every operator has to take: nulls in any column, empty and
very long texts, ties, repeated rows, no rows, extra columns of clashing names."""

import random

import pytest

WORDS = "the and of river mountain window garden letter number story people children water morning evening paper music light stone bridge".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


def with_clashes(df):
    from pyspark.sql import functions as F

    names = "text_key fp label size taken score predicted y ids leaf masked line_no words seed p q n_words kept _q held_out spans found host rule verdict component_id first slot sid target n_lines n_dropped".split()
    return df.select("*", *[F.lit(7).alias(n) for n in names if n not in df.columns])


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = prose(1, 60_000)
    rows = [
        (1, prose(11, 120), "en", "a"),
        (2, prose(11, 120), "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \n\t ", "de", "b"),
        (6, long, "en", "b"),
        (7, long, None, "b"),
        (None, prose(12, 90), "de", "c"),
        (None, prose(12, 90), "de", "c"),
        (8, prose(13, 80), "de", None),
        (8, prose(13, 80), "de", None),
        (9, prose(14, 70), "fr", "c"),
        (9, prose(15, 70), "fr", "c"),
        (10, "x" * 200_000, "fr", "c"),
        (11, "中文 \U0001f600 İſK \x00 ﻿", "zh", "c"),
        (12, "one", "en", "a"),
    ]
    return with_clashes(spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 13)] + [(1, 1, 0), (None, 1, 1), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
