from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, copies string, bucket string, h string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns whose names the operators use themselves."""
    from funnelcast.llm.common import find_package

    find_package(spark)

    def make(rows):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", "y", "z", "w") for i, t, lang, source in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    from funnelcast.llm.common import find_package

    find_package(spark)
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


LONG = "long text of many words " * 20_000
ODD = [(1, "a b c d e", "en", "s"), (1, "a b c d e", "en", "s"), (2, None, None, None), (None, "", "en", None), (3, " \t\n", "de", "s"),
       (None, "ab cde", "en", "t"), (4, "abcde", "en", "t"), (5, LONG, "en", "s"), (6, "é ü\xa0ß 😀 |", "fr", "t"), (7, "abcde ", "en", "t")]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD).repartition(3)


@pytest.fixture(scope="session")
def none(frame):
    return frame([])
