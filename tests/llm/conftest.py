import pytest


@pytest.fixture(scope="session")
def docs(spark):
    def make(*texts, ids=None, **extra):
        rows = [(i if ids is None else ids[k], t, "en", "s") for k, (i, t) in enumerate(enumerate(texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    return make
