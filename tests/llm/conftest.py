from __future__ import annotations

import pytest

#: Rows that every operator on documents must survive: nulls in each column,
#: empty, blank and long texts, exact and repeated copies, and columns whose
#: names the operators use themselves.
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, size string, key string, _key int, id int"

PROSE = " ".join(f"word{i % 97} and thing{i % 61} of place{i % 43}" for i in range(40))
LONG = " ".join(f"term{i}" for i in range(30_000))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "x", "k", 1, 2)


@pytest.fixture(scope="session")
def document_rows():
    return [
        row(1, PROSE), row(2, PROSE), row(3, PROSE + " tail"), row(4, None), row(5, ""), row(6, " \n\t "),
        row(7, LONG), row(8, "short text", None, None), row(9, PROSE[::-1], "de", None), row(None, PROSE, None, "b"),
        row(11, "one line.\none line.\n\none line.", "fr", "b"), row(11, "one line.\none line.\n\none line.", "fr", "b"),
        row(12, "Ñandú 漢字 é  two  spaces\x1c <|endoftext|>\r\n", "es", "ü"), row(13, "12 34 ## $$", "en", "b"),
    ]


@pytest.fixture(scope="session")
def documents(spark, document_rows):
    return spark.createDataFrame(document_rows, DOCUMENT).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)
