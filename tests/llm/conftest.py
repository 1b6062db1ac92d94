import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Cases every operator has to survive; whole rows repeat, ids are null or tie.
ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "ONE"),
    (None, "one two three four five"),
    (None, None),
    (6, "x" * 50_000),
    (7, "word " * 20_000),
    (8, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich.\nÉté 漢字 emoji 😀 end"),
    (8, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich.\nÉté 漢字 emoji 😀 end"),
    (9, "same id, first text of it"),
    (9, "same id, second text of it"),
]


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0 if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd_docs(docs_of):
    return docs_of(ODD_TEXTS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
