"""Small document tables with the awkward cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    """Invented words; equal seeds give equal texts."""
    own = random.Random(seed)
    return " ".join("".join(own.choice("abcdefghiklmnoprstuvw") for _ in range(own.randint(2, 9))) for _ in range(n))


def table(spark, texts, **columns):
    """Documents numbered from 0 with these texts."""
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward():
    """Null, empty, white, short, long, repeated and non-Latin texts, ties and common lines."""
    base = prose(1, 300)
    near = base.split(" ")
    near[150] = "changed"
    return [
        None, "", " \t\n ", "one", "one two", "one two three four", base, base, " ".join(near), base + "\nlast line",
        "\n".join(["Same Line ", "\tsame line", "other"] * 30), prose(2, 4000), "größe Ünicode 日本語 テキスト " * 20, "x" * 5000,
        "\n\n\n", "ends with break\n", prose(3, 40), prose(3, 40).upper(), "# * $ % & | < >", base[:900] + prose(4, 50),
    ]
