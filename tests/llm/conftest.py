import pytest


@pytest.fixture
def frame(spark):
    """Documents of rows (doc_id, text, lang, source), with a column that clashes with inner names."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, lang, s) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string")
        return df.selectExpr("*", "'x' as id", "'y' as rank", "1 as size") if extra else df

    return make
