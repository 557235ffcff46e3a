import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    long = words(30_000, 1)
    rows = [
        (1, None, "en", None, None),
        (2, "", None, "s", 0),
        (3, "the cat sat on the mat " * 3, "en", "s", 1),
        (4, "the cat sat on the mat " * 3, "en", "s", 1),
        (4, "the cat sat on the mat " * 3, "en", "s", 1),
        (5, long, "en", "s", 1),
        (6, long + " tail", "de", "s", 1),
        (7, "Straße für Äpfel \U0001f600 \x00 token=abcdefghijkl", "de", "s", 1),
        (8, " \n\t ", "de", "s", 1),
        (None, "the dog", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({"score": F.lit("x"), "spans": F.lit(1), "n_words": F.lit(None).cast("int"), "c": F.lit(2), "r": F.lit("r"), "row": F.lit(0), "__redacted": F.lit("x"), "id": F.lit(1), "digest": F.lit("d"), "r.redacted": F.lit("dot")})


@pytest.fixture
def write_sf(tmp_path):
    """Write tables as the queries expect them and return the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
