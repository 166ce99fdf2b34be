import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 30

#: Nulls, empty and blank texts, ties, repeats, other scripts, control characters, a long text.
TEXTS = [None, "", " \n\t ", "x", "Hello world, it's 12 o'clock!", "Hello world, it's 12 o'clock!", "naïve façade Ünïcödé ß İ ŉ", "日本語のテキスト です。", "a b\x1cc\x85d e", "é café  two  spaces\n\n tab\t", "<|endoftext|> inside<|endoftext|>of text <|startoftext|>", "😀👍🏽 emoji", LONG, "AAAA!! BBBB!! " * 40, "z" * 5000]


@pytest.fixture()
def docs(spark):
    """A table with clashing column names, a null id and a repeated row."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 2}" if i % 5 else None, len(t) if t else 0, "kept?", i) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", "en", "src0", 10, "", 1), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, id long")


@pytest.fixture()
def empty(docs):
    return docs.where("false")


@pytest.fixture()
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
