"""Phrase mining against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import pytest

from quern.llm import collocations
from tests.llm.helpers import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def truth(rows, least, longest=5, first=2000):
    """``rows``: (language, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(len(w)):
                for m in range(1, min(longest, len(w) - k) + 1):
                    f.setdefault(lang, Counter())[tuple(w[k : k + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        inside = lambda p, q: any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and c >= a and inside(p, q) for q, c in often.items()):
                continue
            cuts = [(floor(Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], k))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s, k) for r, (s, a, p, x, y, k) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def texts(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = "the of and to Über in a éa x# b\x00c 9 ΑΣ".split(" ") + [f"w{k}" for k in range(30)]
    phrase = ["of the and to in", "The Of a", "w1 w2 w3", "über  in\ta", "x# 9"]
    out = []
    for _ in range(n):
        parts = [rng.choice(vocabulary[: rng.choice([4, 40])]) for _ in range(rng.randint(0, 40))] + rng.sample(phrase, rng.randint(0, 4))
        rng.shuffle(parts)
        out.append("".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]) for p in parts))
    return out + ["of the and to in " * 200, "", None, " \t ", ".;!", "z" * 50_000, "aa aa aa aa aa aa aa aa aa aa aa aa"]


def table(spark, rows):
    docs = documents(spark, [(k, t) for k, (_, t) in enumerate(rows)]).drop("lang")
    langs = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(rows)], "doc_id long, lang string")
    return docs.join(langs, "doc_id")


@pytest.mark.parametrize("sizes", [{}, {"most": 40, "dealt": 50}])
def test_collocations_against_brute_force(spark, sizes):
    rows = [(("en", "de", None, "")[k % 4], t) for k, t in enumerate(texts())]
    rows += rows[:5]
    got = [tuple(r) for r in collocations.collocations(table(spark, rows), least=6, **sizes).collect()]
    want = truth(rows, 6)
    assert sorted(got) == want
    assert len({r[0] for r in want}) == 4 and any(len(r[2].split()) == 5 for r in want)


def test_only_frequent_triples_are_followed(spark, monkeypatch):
    """Pairs that are frequent and overlap make no pointers unless their triple is frequent too."""
    rows = [("en", f"p{j} m q{k}") for j in range(9) for k in range(9)] + [("en", "P0 m q0\tz")] * 6
    landed, land = {}, collocations.land
    monkeypatch.setattr(collocations, "land", lambda df, tag: landed.setdefault(tag, land(df, tag)) if tag == "pointers" else land(df, tag))
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows), least=6).collect())
    assert got == truth(rows, 6) and {r[2] for r in got} > {"p1 m", "m q1", "p0 m q0", "p0 m q0 z"}
    assert sum(r.n for r in landed["pointers"].collect()) == 6


def test_ties_at_the_last_rank_go_by_the_phrase(spark):
    rows = [("en", f"p{k} q{k}. Ü{k} é{k}. ") for k in range(20) for _ in range(3)]
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows), least=3, first=7).collect())
    assert got == truth(rows, 3, first=7) and len(got) == 7


def test_no_phrases_and_no_documents(spark):
    assert collocations.collocations(table(spark, [("en", None), (None, ""), ("de", "one two")]), least=2).count() == 0
    assert collocations.collocations(documents(spark, []), least=1).count() == 0


def test_a_clash_of_hashes_is_seen(spark):
    words = spark.createDataFrame([("en", "a", 5, 10), ("de", "b", 5, 1), ("en", "c", 6, 3)], "lang string, word string, h long, n long")
    assert collocations._clash(words, 10) and not collocations._clash(words, 11)
    assert collocations._clash(spark.createDataFrame([("en", "a", 0, 10)], words.schema), 10)


def test_scores_past_64_bits(spark):
    """floor(1000 a n / (l r)) by the engine's decimals, for counts of a very large corpus."""
    rows = [(10**13, 10**14 + 7, 3 * 10**13, 10**13 + 1), (999_999_999_999, 10**15 - 3, 10**12, 999_999_999_999), (100, 10**17, 100, 100)]
    df = spark.createDataFrame(rows, "n long, total long, l long, r long")
    got = [r[0] for r in df.select(collocations.score("n", "total", "l", "r")).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]
