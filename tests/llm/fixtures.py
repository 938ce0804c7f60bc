"""Small tables with the odd cases every operator has to stand."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ren tus vor shi ble qua den".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def changed(text: str, seed: int, n: int) -> str:
    """n words replaced."""
    r, words = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(words)), n):
        words[i] = f"x{seed}y{i}"
    return " ".join(words)


def documents(spark, rows):
    """Rows of (doc_id, text) with the columns of documents and some that clash with names used inside."""
    full = [(d, t, "en", "src", len(t or ""), "clash", 7) for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, h int")


def odd_rows():
    base = prose(1, 120)
    return [
        (1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, base.replace(" ", "  ")), (7, base.upper()), (8, changed(base, 3, 2)), (9, prose(9, 3)), (10, "one"),
        (11, "ünï ☃ 漢字 " * 5), (12, prose(12, 20_000)), (13, prose(13, 60) + "\n" + base), (14, "a\x00b \x1c c\x85d"), (15, "x" * 30_000), (16, prose(16, 200)),
    ]
