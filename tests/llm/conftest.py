import pytest

CLASHING = ["id", "kept", "fp", "path", "score", "order", "k0", "ids"]


@pytest.fixture(scope="session")
def make(spark):
    """make(rows of (doc_id, text[, lang])) -> documents with columns whose names operators use themselves."""
    def build(rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", f"src{(r[0] or 0) % 2}", len(r[1] or ""), *["x"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)
    return build


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "x" * 5000), (7, "word " * 30000), (8, "Ünïcode ﬁ 漢字 \U0001f600 it's we'LL  I'm"),
       (9, "same text"), (9, "same text"), (None, "same text"), (None, None), (10, "a  b\r\n\r\n  c\x1c \x85 d"), (11, "<|endoftext|>a<|endoftext|>")]
