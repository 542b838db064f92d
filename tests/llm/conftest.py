import pytest

TEXTS = [
    None,
    "",
    " \n\t ",
    "The quick brown fox it's a test.",
    "The quick brown fox it's a test.",
    "one",
    "Ünïcode 漢字 😀 text with spaces and 'quotes' I'll x",
    "<|endoftext|>in<|endoftext|> the middle <|startoftext|>",
    "word " * 3000,
    "a" * 5000,
    "line\nline\nline\r\n\r\n  end  ",
    "\x00\x1c\x1d odd \x85 controls",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Texts of all awkward kinds, a null id, a repeated row, and extra columns with clashing names."""
    rows = [(i, x, "en", None if i % 4 == 0 else f"s{i % 3}", len(x or ""), "clash", 1) for i, x in enumerate(TEXTS)]
    rows += [rows[3], (None, "no id", "en", "s0", 5, "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")
