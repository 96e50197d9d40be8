import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly box many big jugs".split()


def prose(seed: int, n: int) -> str:
    """Distinct-looking text: words with a running suffix."""
    return " ".join(f"{WORDS[(seed * 7 + k * (seed % 5 + 1)) % len(WORDS)]}{(seed * 31 + k) % 97}" for k in range(n))


ODD = [
    (None, "a row without an id", "en", "s1", 19),
    (900, None, "en", None, None),
    (901, "", None, "s1", 0),
    (902, " \n\t ", "en", "s1", 4),
    (903, "Ünïcode ▁   中文 😀 \x00 end\r\n", "xx", "s2", 20),
    (904, "word " * 30_000, "en", "s1", 150_000),
    (905, "x" * 60_000, "en", "s1", 60_000),
    (906, "twice the same row", "en", "s1", 18),
    (906, "twice the same row", "en", "s1", 18),
    (907, "<|endoftext|> </s> <0x0A>  double  spaces ", "en", "s1", 42),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, and columns whose names operators use themselves."""
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("t", "w", "lines", "site", "fp", "id", "kept", "hashes", "component_id", "toxic", "shard", "score", "piece", "length", "base", "node", "clean_text", "masked"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
