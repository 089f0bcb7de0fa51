import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, __score string, node int, spans int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows, with extra columns whose names operators use inside."""

    def made(rows):
        full = [(r + (None,) * 4)[:4] for r in rows]
        return spark.createDataFrame([(i, t, a, s, None if t is None else len(t), "x", "y", 1, 2) for i, t, a, s in full], SCHEMA)

    return made


#: Null ids and texts, empty and blank texts, repeated rows and ids, ties, non-ASCII, a very long text.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "src1"),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "src1"),
    (1, "another text with the same number", None, "src2"),
    (None, "alpha beta gamma delta epsilon zeta eta theta", "de", None),
    (None, None, None, None),
    (2, None, "en", ""),
    (3, "", "fr", "src0"),
    (4, " \t\n ", "fr", "src0"),
    (5, "Ünïcödé 🙂 ﬁ \u0000 tail", "de", "src3x"),
    (6, "word " * 30_000, "en", "src0"),
    (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "es", "src4"),
    (9_000_000_000, "alpha beta gamma delta epsilon zeta eta theta", "en", "src1"),
]
