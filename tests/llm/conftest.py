import pytest

LONG = " ".join(f"w{i % 7919}x{i}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and then runs away into the dark green forest today"),
    (2, "The quick brown fox jumps over the lazy dog and then runs away into the dark green forest today"),
    (3, None), (4, ""), (5, " \t\r\n\x0b\x0c "), (6, "one"), (7, "one two"), (8, "ÄÖÜ straße ÇA été"), (9, LONG), (None, "no id here at all"),
    (10, "a\nb\na\nb\na\n\nb"), (11, "\x00 odd \x1c bytes \u2028 here \U0001f600"), (12, "12345 67890 !!! ???"),
]
CLASHES = {c: "null" for c in ("fp", "component", "component_id", "key", "row", "d", "t", "m", "n", "x", "k0", "spans", "epoch", "block", "place", "clean", "_id", "node", "score", "held_out", "lang_pred", "ids")}


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, None if t is None else len(t)) for k, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHES])


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
