import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, piece int, fingerprint string"


def sentence(rng, words, n=9):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abdefiklmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    body = "\n".join(sentence(rng, words) for _ in range(8))
    long = "\n".join(sentence(rng, words, 30) for _ in range(4000))
    texts = {
        1: body, 2: body, 3: body + "\nOne more line at the end.", 4: None, 5: "", 6: " \n\t ", 7: "a", 8: long, 9: long + " end",
        10: "word " * 3000, 11: "\n".join(["same line here"] * 40), 12: "Ça. É ñ ß x y 🙂 \x85", 13: "a  b \n\n c\r\n", 14: "?!", 15: body.upper(),
    }
    rows = [(i, t, "en" if i % 2 else "fr", None, 3, 0.5, True, 9, "x") for i, t in texts.items()]
    return [*rows, rows[0], (None, body, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
