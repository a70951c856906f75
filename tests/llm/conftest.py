import pytest


@pytest.fixture
def docs(spark):
    """Documents with every odd case: nulls, empty, short, repeated rows, ties, and columns whose
    names clash with the operators' own."""
    prose = "The quick brown fox jumps over the lazy dog and then, as dogs do, it sleeps all day in the warm sun."
    rows = [
        (1, prose, "en", "src1", 100),
        (2, prose, "en", "src1", 100),
        (2, prose, "en", "src1", 100),
        (3, None, None, None, None),
        (4, "", "en", "src2", 0),
        (5, "one", "en", "src2", 3),
        (6, " \n\t ", "en", "src2", 4),
        (7, "Über straße naïve\n\ncafé  ÉCOLE<|endoftext|>x", "fr", "src3", 30),
        (8, "word " * 3000, "en", "src1", 15000),
        (9, prose + " Released under the MIT License.", "en", "src1", 130),
        (None, prose + " Nothing else is here to see at all.", None, "src1", 120),
        (10, "漢字かな交じり文。العربية ١٢٣ 😀", "ja", "src3", 20),
    ]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from pyspark.sql import functions as F

    return plain.withColumns({c: F.lit("mine") for c in ("kept", "score", "words_", "key_", "row_", "near_", "n_words", "in_0_")})


@pytest.fixture
def empty(docs):
    return docs.limit(0)
