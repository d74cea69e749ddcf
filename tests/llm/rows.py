"""Rows that several tests use."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long"


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(n))
