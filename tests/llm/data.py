"""Small tables with the awkward cases."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, id string, n string, score string, token string, place string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts(seed=5, count=60):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "one", "one two", "a b c", "A b  C", "ünï çödé ß 😀 日本語 " * 3, "w " * 9000, "x" * 60000, "9" * 20000, "\n" * 50]
    base = [sentence(rng, 80) for _ in range(5)]
    for k in range(count):
        words = base[k % 5].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        out.append(" ".join(words) if k % 3 else sentence(rng, rng.randint(1, 120)))
    out += [base[0]] * 3
    return out


def documents(spark, rows=None):
    """Unique ids but for a repeated row, and columns whose names the operators use themselves."""
    rows = list(enumerate(texts())) if rows is None else rows
    more = rows + [rows[20]] if len(rows) > 20 else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "h", "i", "n", "s", "t", "p") for i, t in more], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
