import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, band int, payload binary, part int, _task int"


@pytest.fixture(scope="session")
def odd(spark, sf_dir):
    """The smallest documents and awkward ones, with columns named like the operators' own."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").collect()]
    passage = " ".join(f"word{i} is here" for i in range(30))
    rows += [
        (1000, None, "en"),
        (1001, "", None),
        (1002, " \t\n\x0b\x0c\r ", "en"),
        (None, "no id " + passage, "en"),
        (None, "no id " + passage, "en"),
        (1003, passage, "xx"),
        (1004, "before. " + passage + " after", "xx"),
        (1005, passage.replace(" ", "\n"), "xx"),
        (1006, "of " * 400, "en"),
        (1007, "of " * 400, "en"),
        (1008, "aé😀漢 " * 100 + "it's we're I'LL  don''t <|endoftext|> x <|endof", "en"),
        (1009, "aé😀漢 " * 100 + "\U00020000\U00020001 rare", "en"),
        (1010, passage + " one", "en"),
        (1010, passage + " two", "en"),
        (1011, passage + " one", "en"),
        (1011, passage + " one", "en"),
        (-5, "negative id " + passage, "en"),
        (1012, "x" * 30_000, "en"),
        (1013, passage * 40, "en"),
    ]
    frame = spark.createDataFrame([(i, t, lang, "s", None, 1, b"", 2, 3) for i, t, lang in rows], SCHEMA)
    return frame.coalesce(3)


@pytest.fixture(scope="session")
def rows(odd):
    return [(r["doc_id"], r["text"] or "") for r in odd.collect()]


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
