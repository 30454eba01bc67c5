"""Plain Python counterparts of the operators, and awkward documents."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def awkward_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows and a long text."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "Über", "été"]) for _ in range(n))
    long = say(3_000)
    rows = [
        (1, None, "en", "s", 0),
        (2, "", "en", "s", 0),
        (3, " \t\n ", None, None, 0),
        (4, "The cat sat on the mat.", "en", "s", 1),
        (4, "The cat sat on the mat.", "en", "s", 1),
        (5, "the CAT sat on the mat.", None, "t", 1),
        (6, long, "en", "t", 1),
        (7, long + " end", "en", "t", 1),
        (None, say(20), "en", "t", 1),
        (8, "12345 67890 !!", "de", None, 1),
        (9, "\U0001f642\U0001f642 中文", "zh", "t", 1),
    ]
    return rows + [(10 + i, say(rng.randint(5, 60)), rng.choice(["en", "de"]), "t", 1) for i in range(20)]


def roots(links) -> dict:
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}
