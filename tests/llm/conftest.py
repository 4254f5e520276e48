import duckdb
import pytest

EDGE_TEXTS = [None, "", " \t\n", "one", "one two", "Two  words\nand a line", "x " * 30000, "naïve café \U0001f389", "same text here", "same text here"]


@pytest.fixture(scope="session")
def documents(sf_dir):
    """(doc_id, text) of the smallest table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture
def edge(spark):
    """Documents with null, empty, long and repeated texts, a null and a repeated id, and clashing columns."""
    rows = [(i, t, "en", "s", 1, "a", 2) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "no id at all", None, None, None, None, None), (3, "one", "en", "s", 1, "a", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, _rank int")
