"""Small tables for the tests: odd rows, and extra columns that are named like those inside the operators."""

import random

#: Names that operators use inside.
EXTRA = ["fp", "key", "h", "_id", "_text", "_spans", "_doc", "_sha", "good", "count", "n", "part", "ids", "block"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{x} string" for x in EXTRA)


def words(n, seed, of=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(of)}" for _ in range(n))


def docs(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *EXTRA) for i, t in rows], SCHEMA)


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, near copies, a long text, odd characters."""
    base = words(80, 1)
    return [
        (7, "one two three four"), (3, "one  two\tthree\nfour"), (3, "one  two\tthree\nfour"), (9, "One Two Three Four"),
        (None, "one two three four"), (None, None), (4, None), (5, ""), (6, " \n\t "), (10, "x"), (11, "x y"), (12, "x y z"),
        (20, base), (21, base.replace("w", "W", 3)), (22, base + " tail"), (23, words(200, 2)), (24, words(200, 3) + " " + base),
        (30, "é ñ 漢字   x y <|endoftext|> \U0001f600"), (31, words(20_000, 4)), (32, "la " * 3000), (33, "la " * 3000),
        (40, words(60, 5)), (40, words(60, 6)),
    ]
