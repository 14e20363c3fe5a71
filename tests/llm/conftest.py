import pytest

#: Rows that every operator has to take: null, empty, without letters, ties,
#: repeated rows, control strings, a long line, columns whose names clash.
ODD = [
    (1, None), (2, ""), (3, " \n\n"), (4, "123 !?"), (5, "The cat sat on the mat. It was all rights reserved."),
    (6, "The cat sat on the mat. It was all rights reserved."), (6, "The cat sat on the mat. It was all rights reserved."),
    (7, "<|im_end|><\\|im_start|> ünï   漢字 \U0001f600 é"), (8, "word " * 30_000), (9, "a"), (None, "an id that is null here"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "src", len(t or ""), "x", 1, "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, batch string, kind int, score string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
