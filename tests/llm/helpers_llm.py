"""Small tables for the text operators' tests."""

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "word"),
    (6, "a  b   c\n\nd \n e " * 3),
    (7, "x" * 50_000),
    (8, ("one two three four five six seven " * 3_000).strip()),
    (9, "1" * 30_000),
    (9, "same id, other text"),
    (1, "The quick brown fox jumps over the lazy dog and runs away."),
    (None, "no id at all"),
    (None, None),
    (10, "日本語 und ελληνικά 😀 ▁ ﻿ é <|endoftext|> <s> 's 12.5%"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, key string, node string, row string"


def awkward(spark, rows=AWKWARD):
    """Every awkward text, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", "n", "r") for i, t in rows], SCHEMA)


def rows_of(df, *columns):
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
