import pytest


#: Nulls, empty and long texts, ties and repeated rows: (doc_id, text).
AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "same words here again and again"), (5, "same words here again and again"), (5, "same words here again and again"), (None, "a null id"), (7, "one"), (8, "long words " * 20000), (9, "x" * 70000), (10, "é ü 日本語 🙂 ﬁ"), (11, "call +1 (212) 555-0142 or a.b@c.example.org from 10.0.0.1")]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with extra columns whose names clash with what operators use inside."""
    rows = [(i, t, "en", "src0", len(t or ""), 1, "x", 2, "h2", 3, 4, 5, "row") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, fp string, part int, _h2 string, _id int, _h int, root int, row string")


@pytest.fixture(scope="session")
def no_documents(awkward):
    return awkward.where("false")
