"""Small document tables with every awkward case."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body binary, gid int, label int, fp string, order int, `odd name` string"

TEXTS = [
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "the quick brown fox jumps over the lazy dog near the river bank todaY",
    None,
    "",
    "   \n\t ",
    "a",
    "a",
    "naïve café Ünïcode 日本語 text 😀 with <|endoftext|> inside",
    "x" * 5000,
    "x" * 4999 + "y",
    "word " * 4000,
    'token = "0641917ea4e9feb9cda83477b57ac2654884f485" and commit 0641917ea4e9feb9cda83477b57ac2654884f486 end',
    "mail a@b.co call +1 (234) 567-8901 card 4111 1111 1111 1111 ip 10.0.0.1 iban DE89 3704 0044 0532 0130 00",
]


def rows(texts=TEXTS):
    return [(k, t, None if k % 3 else "en", f"src{k % 2}", None if t is None else len(t), b"b", 1, 0, "f", k, None) for k, t in enumerate(texts)]


def docs(spark, texts=TEXTS, extra=()):
    """Rows of the texts, two repeated rows, a null id, and ``extra`` rows; all columns may clash with inner names."""
    own = rows(texts)
    more = [own[0], own[0], (None, texts[0], None, None, None, None, None, None, None, None, None)] if texts else []
    return spark.createDataFrame([*own, *more, *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
