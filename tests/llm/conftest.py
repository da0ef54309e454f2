import pytest

#: Columns that clash with names the operators make or use inside.
CLASH = "size long, m string, d string, fp string, row string, kept string, target string, part string, bits string, text_ string"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text, lang, source) with clashing columns beside them."""

    def make(rows):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        wide = [(i, t, l, s, len(t or ""), 7, "x", "x", "x", "x", "x", "x", "x", "x", "x") for i, t, l, s in rows]
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
        return spark.createDataFrame(wide, schema)

    return make


@pytest.fixture(scope="session")
def documents(sf, duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="session")
def odd():
    """Texts that are empty, of white space, of marks, very long, or without any break."""
    return [
        None, "", " ", "\n\n\t", "a", "a b", "Ab, cd. ef", "x" * 5000, "a1" * 2000, "日本語" * 700, "é é " * 400,
        "'s't're" * 300, "<|endoftext|>" * 40 + " b<|startoftext|>c", "  two  spaces\n\n and\ttabs ", "a.\nb, c..d ,e",
        "word " * 3000, "one two three four five six seven eight " * 3, "\x1c a \x1d", "no-break space   wide",
    ]
