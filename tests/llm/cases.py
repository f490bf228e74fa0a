"""Small document tables for the tests: hard cases, and texts with copies, near copies and shared passages."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size double, `at` int"


def rows_of(texts, first=0, langs=("en", "de"), sources=("b", "a", None)):
    return [(first + i, t, langs[i % len(langs)] if langs else None, sources[i % len(sources)], None if t is None else len(t), 7, "x", 0.5, 1)
            for i, t in enumerate(texts)]


def edge_rows():
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", " \t\n", "a", "one two three four", "same text in two rows", "same text in two rows", "ÄÖÜ éàç 日本語  x", "x" * 5000, long,
             "don't 's <|endoftext|> 12", "...!!!", "A  b\x0bc\rd", "é \U0001F600"]
    rows = rows_of(texts)
    rows.append(rows[6])  # a row that repeats exactly
    rows.append((None, "no id here but some words", None, None, None, None, None, None, None))
    return rows


def copy_rows(n=60, seed=5):
    """Near copies of a few bases, exact copies, shared passages, repeated lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    bases = [[word() for _ in range(rng.randint(60, 160))] for _ in range(4)]
    passage = [word() for _ in range(40)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind < 3:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
        elif kind == 3:
            w = [word() for _ in range(rng.randint(1, 80))] + passage + [word() for _ in range(rng.randint(0, 80))]
        elif kind == 4:
            w = [word() for _ in range(rng.randint(0, 120))]
        else:
            w = ["line", "again", "and", "again"] * rng.randint(1, 40)
        texts.append(" ".join(w) if rng.random() < 0.9 else "  ".join(w).upper())
    order = list(range(n))
    rng.shuffle(order)
    rows = rows_of(texts)
    return [rows[i] for i in order]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
