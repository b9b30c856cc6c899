import random

import pytest

from tests.llm.helpers import NAMES, prose


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empties, ties, repeats, a very long text and columns whose names operators use inside."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [None, "", " \t\n ", "one two", "Café 日本 \U0001f642 ▁ x y", base, base, base.upper(), base.replace(" ", "  "),
             base + "\n" + prose(rng, 3), "\n".join(prose(rng, 9) for _ in range(12)), prose(rng, 30000), "a" * 3000, "a" * 3000,
             "mail Bob.X@mail.example.org or 10.0.0.255 now", "\n\n", "12345", base]
    rows = [(k, t, ["en", None, "de"][k % 3], ["s1", None, "s2"][k % 3], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(None, "no id at all " * 4, "en", "s1", 5), (5, base, "en", "s1", 7), (rows[10][0], rows[10][1], "en", "s1", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
