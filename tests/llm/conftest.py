import random

import pytest
from pyspark.sql import functions as F

# Names that the operators use for columns of their own.
CLASHING = ["bucket", "members", "key", "keys", "uses", "part", "hash", "length", "id", "component", "tail", "row",
            "copies", "template", "line", "shard", "label", "word", "token", "file", "digest", "lang"]


def words(rng, count, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(count))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with every case that may go wrong."""
    rng = random.Random(5)
    base = words(rng, 120)
    long = words(rng, 60_000, 50_000)
    line = "this very line stands in many documents of the table"
    rows = [
        (1, base), (2, base), (2, base),  # copies, and a repeated row
        (3, base.replace("w1 ", "other ", 1) + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  TWO"),
        (9, long), (10, long + " more"), (None, base), (None, None), (11, "ünï çödé ñ 北京 \U0001f600 text"), (12, "12345 !!!"),
    ]
    rows += [(20 + n, f"{words(rng, 15)}\n  {line.upper()} \n{words(rng, 5)}") for n in range(7)]
    rows += [(40, f"{line}\n{line}\n")]
    return rows


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    frame = spark.createDataFrame(odd_rows, "doc_id long, text string")
    return frame.withColumns({name: F.lit(f"x-{name}") for name in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
