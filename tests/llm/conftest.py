import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sa", "ne", "lo") for b in ("n", "r", "st", "ll", "ma", "ti", "zo", "ck")]
#: Columns of the operators' own results, to clash with.
CLASHING = ["v", "k", "m", "c", "h", "w", "doc", "size", "copies", "score", "rejected", "lang_pred", "links", "root", "target", "source_size", "comp", "n", "first"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def edge_texts():
    a, b = prose(1, 120), prose(2, 90)
    near = a.split()
    near[60] = "CHANGED"
    return [
        (5, a, "en", "s1"),
        (3, b, "en", "s1"),
        (8, a, "en", None),
        (9, " ".join(near), "de", "s2"),
        (9, a + "\n" + b, None, "s2"),  # one id, another text
        (10, "x " + b + " y", "fr", "s0"),
        (11, None, "en", "s1"),
        (12, "", "en", "s3"),
        (13, " \n\t\x0b ", "en", "s3"),
        (14, "one two", "en", "s1"),
        (15, "one two", "en", "s1"),
        (15, "one two", "en", "s1"),  # a repeated row
        (None, b, "en", "s1"),
        (None, None, None, None),
        (20, "same " * 400, "de", "s2"),
        (21, prose(3, 60_000) + " " + a, "fr", "s0"),  # very long
        (22, "a b c d e f g " * 12, "de", "s1"),  # repeats itself
        (23, "日本語 のテキスト 😀 " * 30, "ja", "s1"),
        (24, "12345 67890 !!", "en", "s1"),
        (2, prose(4, 40) + "\n" + prose(5, 25) + "\n" + prose(4, 40), "en", "s1"),
        (1, prose(5, 25), "en", "s1"),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in edge_texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(edges):
    return edges.withColumns({name: F.lit("x") for name in CLASHING})


@pytest.fixture(scope="session")
def no_docs(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    from ledgerframe.llm.common import table

    return table(spark, sf_dir, "documents")
