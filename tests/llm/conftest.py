import random

import pytest

#: Columns whose names clash with those that operators make.
SCHEMA = "doc_id long, text string, n_words int, spans string, row int, key string, component_id string, start int, kept string, u int, item_id int"


def table(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text); the other columns are filled with nulls."""
    width = len(schema.split(",")) - 2
    return spark.createDataFrame([(*r, *[None] * width) for r in rows], schema)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, short, long, repeated and tied rows."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000, 3000))
    same = " ".join(words(rng, 80))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, long), (7, same), (8, same), (8, same), (None, same), (None, None), (9, "é 日本 👍 " * 40), (10, "a\n" * 60)]
