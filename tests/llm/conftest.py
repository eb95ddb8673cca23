import pytest

#: Names that the operators use inside; as columns of an input they must not disturb anything.
CLASHING = ("row", "fp", "rid", "record", "shard", "slot", "cell", "bucket", "size", "digest", "w", "l", "lang2", "kept", "gone", "lines", "n_words", "__x", "component_id", "node", "rep", "score", "ids", "id", "of", "key", "at", "n_lines", "n_deleted", "a.b", "a`b", "__key", "__id", "__rid", "__row", "__gone", "__worded", "left", "right", "item_id", "turn", "found")

LONG = " ".join(f"word{i % 997}x{i}" for i in range(30000))
PROSE = "The committee of the town said that it was to be at the house for the day and with it the rest of the year. " * 1


def prose(seed: int, n: int = 120) -> str:
    """Plain English-like text: common words between made-up ones, no two alike."""
    import random

    rng = random.Random(seed)
    common = "the of and to in a is that it for was on are as with be at by this from or an not".split()
    return " ".join(rng.choice(common) if rng.random() < 0.45 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in any column, empty and very long texts, ties and repeated rows."""
    a, b = prose(1), prose(2)
    return [
        (1, a, "en", "s", 1),
        (2, a, "en", None, None),
        (2, a, "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (5, " \t\n\x0b\x0c\r ", "xx", "s", 7),
        (None, b, "en", "s", 2),
        (None, None, None, None, None),
        (6, LONG, "en", "s", 3),
        (7, "one", "de", "s", 4),
        (8, "a\n" * 300, "en", "s", 5),
        (9, "\\ <|im_end|> \x00 🙂 ▁ é É", "fr", "s", 6),
        (10, b + "\n" + a, "en", "s", 6),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)), F.create_map(F.lit("k"), F.col("n_chars")).alias("map"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
