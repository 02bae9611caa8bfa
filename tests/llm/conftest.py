import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int, words=("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta")) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns with names that operators use."""
    long = prose(1, 30_000)
    rows = [
        (0, prose(2, 120), "en", "a", 1), (0, prose(2, 120), "en", "a", 1), (1, prose(2, 120), None, None, None), (2, None, "en", "b", 0), (3, "", "de", "b", 0), (4, " \n\t ", "de", "b", 4),
        (5, long, "en", "b", 9), (6, long + " end", "en", "b", 9), (None, prose(3, 80), "fr", "c", 2), (None, None, None, None, None), (7, "one", "fr", "c", 3), (7, "two words", "fr", "c", 3), (8, "x" * 50_000, "en", "c", 5),
        (9, "naïve  café — 日本語 <|endoftext|> it's", "fr", "c", 2), (10, "MIT License " * 40, "en", "d", 2),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = {c: "clash" for c in ("n_tokens", "sketch", "words", "term", "at", "h", "label", "lang_pred", "score", "detections", "n_words", "piece", "length", "part", "rank", "a", "b", "v", "f", "n", "cuts", "cut_id", "order", "lang_score")}
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(v).alias(k) for k, v in clash.items()))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
