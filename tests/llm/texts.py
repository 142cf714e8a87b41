"""Awkward documents that every text operation has to handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    long_line = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, 4),
        (4, "x", "en", "a", 1),
        (5, "x", "en", "a", 1),
        (5, "x", "en", "a", 1),
        (6, long_line, "en", "b", len(long_line)),
        (7, "one line\none line\n\none line \n", "en", "b", 29),
        (8, "Häuser & Gärten # ßü 😀 <b>|$%*", "de", None, 30),
        (9, "\x0bword\x0cword\rword\tword\x85word word", None, "b", 30),
    ]
    return rows


def crowd(n=60, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "to", "su", "vi", "ze")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    texts += [t + " extra" for t in texts[:10]] + texts[:5]
    return [(100 + i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t)) for i, t in enumerate(texts)]
