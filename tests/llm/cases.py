"""Documents that try every operator: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, th long, sid long, n int, a int, rank int, size long, first string, tok long, `__salt` int, line int, copies long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base, long = words(rng, 300), words(rng, 9000)
    shared = words(rng, 120)
    near = base.split()
    near[150] = "changed"
    lines = [words(rng, 5) for _ in range(9)]
    out = [
        base, base, " ".join(near), base.upper(), long, long + " end", shared + " " + words(rng, 80), words(rng, 70) + " " + shared, None, "", " \n\t ", "one", "two words", "a b c",
        "\n".join(lines), "\n".join(lines[3:] + ["other"]), "x\n" * 12, "\n\n\n\n", "\n".join(["r"] * 9), "ñandú 漢字 🙂🙂 <|endoftext|> it's 12,5  　 z\x00", "q" * 3000, "idiot trash you are a loser " + words(rng, 20),
    ]
    return out


def documents(spark, rows=None):
    if rows is None:
        t = texts()
        rows = [(i * 2, x, ["s1", "s2", "s3", None][i % 4]) for i, x in enumerate(t)]
        rows += [rows[0], rows[0], (None, t[0], "s1"), (None, None, None), (3, t[6], "s2"), (4, "x\n" * 12, "s2"), (6, "same id, other text", "s1")]
    full = [(d, x, "en" if d is not None else None, s, len(x) if x is not None else None, "k", 1, 2, 3, 4, 5, 6, "f", 7, 8, 9, 10) for d, x, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return documents(spark).limit(0)


def rows_of(df, *cols):
    """Rows as tuples; the operators may order them anyhow."""
    return [tuple(r[c] for c in cols or df.columns) for r in df.collect()]
