"""Small corpora with the awkward cases in them."""

from __future__ import annotations

import random

EDGES = [(900, None), (901, ""), (902, "   \n\t "), (903, "one"), (904, "one"), (905, "ONE two"), (None, "no id here at all"), (906, "w " * 3000)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text): unique texts, exact copies, near copies of several degrees, shared passages, and the cases of EDGES."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 30), []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or not rows:
            text = prose(rng, rng.randint(1, 120))
        elif kind < 0.55:
            text = rng.choice(rows)[1]
        elif kind < 0.8:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            text = " ".join(words)
        else:
            text = f"{prose(rng, 20)} {passage} {prose(rng, 20)}"
        rows.append((i, text))
    return rows + EDGES
