import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for themselves.
CLASHES = ("key", "fp", "copy", "size", "target", "hash", "at", "score", "lang_pred", "_row", "_key", "_n", "_text", "_size")


@pytest.fixture(scope="session")
def documents(spark):
    """Texts, or (doc_id, text), or (doc_id, text, lang, source) rows as a documents table."""

    def make(rows, clashes=False):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, lang, source = row if isinstance(row, tuple) and len(row) == 4 else (
                (*row, "en", "s") if isinstance(row, tuple) else (i, row, "en", "s")
            )
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        if clashes:
            df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
        return df

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """NULLs in every column, empty and blank texts, one very long word and one very long
    text, repeated rows, one doc_id with two texts, clashing names."""
    words = [f"w{i * 7919 % 1013}" for i in range(60_000)]
    rows = [
        (0, None, None, None), (1, "", "en", "s"), (2, " \t\n ", "en", "s"), (3, "one", None, "s"),
        (4, "one two three four five six seven", "en", None), (5, "x" * 100_000, "de", "s"),
        (6, " ".join(words), "en", "t"), (7, "the same row again", "fr", "t"), (7, "the same row again", "fr", "t"),
        (8, "first text of eight", "en", "u"), (8, "second text of eight", "en", "u"),
        (None, "no id here at all", "en", "u"), (None, "no id here at all", "en", "u"), (9, "é ü 漢字 🙂 ß", "de", "v"),
        (10, "\x00 odd   separators \x1f", "en", "v"),
    ]
    return documents(rows, clashes=True)


def collected(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
