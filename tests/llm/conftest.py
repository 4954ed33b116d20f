import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "key", "h", "bin", "block", "digest", "bands", "ids", "held_out", "lang_pred", "n", "kept"]


def edge_rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [(1, "one two three four five six seven"), (2, None), (3, ""), (4, long),
            (5, "one two three four five six seven"), (6, "repeated whole row here\nwith two lines"),
            (6, "repeated whole row here\nwith two lines"), (7, "one id"), (7, "two texts"), (None, "no id at all"),
            (9, "   \n\n  "), (10, "!!! ??? ###"), (11, "Größe\u3000naïve\u00a0\x1c ends  "), (12, "a"), (13, "x" * 5000),
            (14, "<|endoftext|> is 'tis it's\t\ttabs"), (15, " leading space, and . dots ,, end ")]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, None if i == 1 else "en", None, None) for i, t in edge_rows()], DOCS)
    return df.repartition(3).withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
