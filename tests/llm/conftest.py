import pytest

from tamarack.llm.common import short_batches


@pytest.fixture()
def docs(spark):
    """A maker of documents tables: rows (doc_id, text) with the other columns, and some whose names clash with ours."""
    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key int, rep int, keys string, score string"
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "x", 1, 2, "k", "s") for i, t in rows], schema)

    short_batches(spark)
    return make


#: An id that floats can't hold.
HUGE = (1 << 60) + 1
