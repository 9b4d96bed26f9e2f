"""Small corpora with the awkward cases every operator has to stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta rivet stone cloud under sage mint river north quartz ember".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", ","]) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose, copies, near copies, repeated lines, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([3, 4, 5, 40, 120, 300])) + "\n" + "Shared footer line of the site."
        rows.append([i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), 0])
    for i in range(0, 12, 3):
        rows[i + 1][1] = rows[i][1]
        parts = rows[i][1].split(" ")
        if len(parts) > 30:
            parts[5] = "changed"
        rows[i + 2][1] = " ".join(parts)
    rows[20][1], rows[21][1], rows[22][1], rows[23][1] = None, "", " \t\n ", "Ünï code \x0b\x0c\r x"
    rows[24][1] = "one two " * 3000
    rows[25][1] = "é" * 2500
    rows[26] = list(rows[27])
    rows[28][0] = None
    return [tuple(r) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS)


def clashing(spark, rows=None):
    """The corpus with further columns whose names the operators use for themselves."""
    out = frame(spark, rows)
    for name in ("size", "score", "kept", "n_words", "rank", "key", "host", "copies", "_words", "length"):
        out = out.selectExpr("*", f"'x' AS `{name}`")
    return out
