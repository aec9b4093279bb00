"""Documents that hold the hard cases: nulls, empties, long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "er", "th", "ing", "on", "es", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    long = words(rng, 20000)
    base = words(rng, 200)
    near = base.replace(" ", " ", 1).split(" ")
    near[100] = "changed"
    texts = [None, "", " \t\n", "one", "two words", "one two three four five", base, base, " ".join(near), long, "İstanbul's ΣΑΣ 👩‍👩‍👧 ½", "x" * 30000]
    out = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(100 + i, words(rng, rng.randint(1, 60)), rng.choice(["en", "de", None]), None, 1) for i in range(40)]
    return [*out, out[6], (None, "no id here", None, None, None), (None, base, None, None, None)]


def frame(spark, data=None, extra: bool = True):
    """The rows, with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    if extra:
        df = df.selectExpr("*", "1 AS piece", "'x' AS fingerprint", "2 AS rank", "3 AS length", "4 AS h", "5 AS id", "'y' AS bucket")
    return df
