"""Small documents with every awkward case."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, norm string, salt int, packed string, size int, "
    "target string, epochs int, extra string, hilbert int, shard string, ids string, quality string, words string, keep_id string, line string"
)
#: Columns whose names the operators use themselves.
CLASHES = (None, "x", 1, "p", 7, "t", 2, "e", 3, "s", "i", "q", "w", "k", "l")

WORDS = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in ("n", "r", "st", "")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if i % 12 == 11 else "") for i in range(n)) + "."


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def awkward_texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base, second = prose(rng, 120), prose(rng, 60)
    passage = prose(rng, 90)
    texts: list[str | None] = [None, "", " \t\n", "one", "One", "a b c d", "a b  c\td", "a b c d e", base, base, base + " ", base.upper()]
    texts += [edited(rng, base, n) for n in (1, 1, 2, 3, 6, 12)]
    texts += [edited(rng, second, n) for n in (0, 0, 1, 2, 4)]
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 25)}" for _ in range(4)]
    texts += [prose(rng, n) for n in (3, 40, 80, 200)]
    texts += ["spam " * 300, "x" * 2000, "é日本😀 ünïcode " * 40, prose(rng, 6000), "na na na na na na"]
    return texts


def documents(spark, texts=None, repeat: bool = True):
    texts = awkward_texts() if texts is None else texts
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", "s3", None)[i % 4], None if t is None else len(t), *CLASHES) for i, t in enumerate(texts)]
    if repeat and rows:
        rows += [rows[8], rows[0]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
