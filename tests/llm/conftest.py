import pytest


def thue_morse(n, one, two):
    """A word and its complement: equal under every hash that is a sum over symbols times powers, modulo 2^64."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join((one, two)[b] for b in bits), "".join((two, one)[b] for b in bits)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, words that weak hashes confuse, extra columns with the names that operators use themselves."""
    long = "Lorem ipsum dolor sit amet, consectetur. " * 20_000
    one, two = thue_morse(2048, "a", "b")
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, long), (5, " \n\t "), (6, "x"), (7, "a b c"), (None, None), (8, one), (9, two)]
    names = ["key", "fp", "row", "row_id", "row_key", "gone", "gone_id", "gone_key", "keep_id", "keep_key", "n_lines", "deleted", "group", "node", "text_key", "rare", "word", "rid"]
    data = [(i, t, "en" if t else None, "s", len(t or ""), 1.0, 7, *["k"] * len(names)) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, id long, " + ", ".join(f"`{c}` string" for c in names))
