"""Small tables that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(3)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = prose(40_000, 1)                       # some 220,000 characters in one line
ROWS = [
    (1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, " \t\n ", None, "s2", 4), (4, LONG, "en", "s2", 9),
    (5, prose(60, 2), "de", None, 9), (5, prose(60, 2), "de", None, 9),          # a repeated row
    (6, prose(60, 2), None, "s1", 9), (7, prose(60, 3), "fr", "s3", 9), (8, "one", "de", "s3", 3),
    (9, "12 34 5678 -- ++", "en", "s3", 9), (10, "ÄÖÜ éè 漢字 \U0001f600", "fr", "sé", 9),
    (None, prose(50, 4), "en", "s1", 9), (None, None, None, None, None), (11, "a\x00b c", "en", "s1", 5),
]


def edge(spark):
    """The rows above, with columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("size", "row", "block", "k1", "w", "target", "score", "curve", "shard", "slot", "key", "epoch", "kept"):
        df = df.selectExpr("*", f"'x' as {c}")
    return df


def empty(spark):
    return edge(spark).where("false")
