import pytest

#: Documents with the awkward cases: nulls, empty, white space, repeats, a long text, clashing extra columns.
SCHEMA = "doc_id long, text string, lang string, kept boolean, score double, shard int, spans string"


def rows(*pairs):
    return [(i, t, "en", False, 0.5, 3, "x") for i, t in pairs]


@pytest.fixture(scope="session")
def make(spark):
    def made(*pairs):
        return spark.createDataFrame(rows(*pairs), SCHEMA)

    return made
