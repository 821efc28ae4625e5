"""Small inputs that the operator tests share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, ids string"

TEXTS = [
    (1, "One two three four five. One two three four five."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "word " * 5000),
    (6, "It's naïve café 42, isn't it? <|endoftext|> \x1c ok"),
    (7, "One two three four five. One two three four five."),
    (7, "One two three four five. One two three four five."),
    (None, "no id here"),
    (8, "日本語 テキスト ﷺ   x"),
]


def docs(spark, rows=TEXTS):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, 7, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)
