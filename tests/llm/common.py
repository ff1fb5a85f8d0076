import random

ODD_TEXTS = [None, "", " ", "\n\n", "a", "'s 'll don't", "x" * 70_000, "ab " * 30_000, "é́ ñ 中文 \U0001f600 \x1c", "same line\nsame line\nsame line", "tab\there\r\nthere"]


def texts(seed, n, alphabet="ab'stre  \n\t.,!12éß中"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def documents(spark, seed=1, n=200):
    """Odd and random texts, a repeated row and a null id."""
    rows = list(enumerate(ODD_TEXTS + texts(seed, n)))
    return frame(spark, rows + [rows[3], (None, "no id")])
