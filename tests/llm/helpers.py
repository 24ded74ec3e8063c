"""Fixtures with the awkward cases, and plain-Python truths."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, digest string, __n string"


def documents(spark, rows):
    """A documents table from (doc_id, text) with extra columns whose names clash with the operators' own."""
    data = [(i, t, ("en", "de", None)[k % 3], f"src{k % 12}", len(t or ""), "fp", "id", "digest", "n") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS)


def words(text):
    return WORD.findall(text or "")


def corpus(n=60, seed=3):
    """Random documents with copies, near copies, shared lines, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = ["A Shared Line of Text.", "  a shared line of text.\t", "short", "Another line that Repeats"]
    rows = []
    for i in range(n):
        lines = [line(rng.randint(1, 14)) for _ in range(rng.randint(1, 9))]
        lines += rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, rows[1][1] + " x"), (n + 3, ""), (n + 4, None), (n + 5, " \t\n\x0b "), (n + 6, line(4000))]
    rows += [(n + 7, "A\x00b  c 'S it'S <|endoftext|> İ ΑΣ ΑΣ. é é ́x\r\n12 3.5!!"), (n + 8, "A Shared Line of Text.\n\n\nA Shared Line of Text.")]
    return rows
