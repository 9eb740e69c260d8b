import random

import pytest
from pyspark.sql import types as T

from faultline.llm.shipping import ready

EXTRA = ["key", "node", "hub", "place", "size", "copies", "label", "row", "ref", "_row"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in EXTRA],
    ]
)


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ready(spark)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with clashing columns."""

    def build(rows):
        full = []
        for row in rows:
            doc_id, text, source = (*row, "s")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text), *EXTRA))
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def label_frame(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


WORDS = [a + b for a in ("th", "er", "on", "an", "re", "he", "ti", "st") for b in ("a", "ed", "ing", "é", "ly")]


@pytest.fixture(scope="session")
def prose():
    def build(seed, count):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n"]) for _ in range(count))

    return build


@pytest.fixture(scope="session")
def odd(prose):
    """Nulls, empty and blank texts, a very long one, copies, ties and repeated rows."""
    long = prose(1, 60_000)
    return [
        (1, prose(2, 80)), (2, prose(2, 80)), (3, None), (4, ""), (5, " \n\t "), (6, "one"),
        (7, long), (8, long + " end"), (9, prose(3, 40) + " " + prose(4, 30)), (10, prose(5, 25) + " " + prose(4, 30)),
        (None, prose(2, 80)), (None, prose(6, 60)), (None, None), (11, prose(7, 50)), (11, prose(7, 50)),
        (11, prose(8, 50)), (12, "x " * 70), (13, "İstanbul ŞŞ   　 漢字 " * 9),
    ]
