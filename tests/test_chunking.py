"""Chunkers and text utilities: exact cases, and properties on random Markdown."""

from __future__ import annotations

import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking as C

SMALL = C.ChunkerConfig(chunk_size=40, chunk_overlap=8, min_chunk_size=10, max_chunk_size=60)


def test_config_is_checked():
    for bad in ({"chunk_size": 0}, {"chunk_overlap": -1}, {"chunk_overlap": 512}, {"min_chunk_size": -1}, {"max_chunk_size": 100}):
        with pytest.raises(ValueError):
            C.ChunkerConfig(**bad)
    for bad in ({"similarity_threshold": 1.5}, {"buffer_size": 0}, {"breakpoint_percentile": 100}):
        with pytest.raises(ValueError):
            C.SemanticConfig(**bad)


def test_sizes_and_white_space(spark):
    rows = [("", 0), ("a", 1), ("abcd", 1), ("abcdefgh", 2), ("ä" * 9, 2)]
    got = spark.createDataFrame(rows, "t string, n int").select("n", T.token_estimate(F.col("t")).alias("e"), F.col("t")).collect()
    assert all(r.n == r.e == C.estimate(r.t) for r in got)
    texts = ["  a   b \n\n\n\n c  ", "\n\n", "x\n\ny", "\ta\t\tb\n", "one"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_whitespace(F.col("t")).alias("n")).collect()
    assert all(r.n == C.tidy(r.t) for r in got)
    assert C.tidy("  a   b \n\n\n\n c  ") == "a b \n\n c"


def test_ranges_headers_and_separators(spark):
    text = "1. one\n2. two\n\ntext\n- a\n* b\n\n```\ncode\n```\n~~~\nmore\n~~~"
    assert [text[a:b] for a, b in C.numbered_ranges(text)] == ["1. one\n2. two\n"]
    assert [text[a:b] for a, b in C.bullet_ranges(text)] == ["- a\n* b\n"]
    assert [text[a:b] for a, b in C.code_ranges(text)] == ["```\ncode\n```", "~~~\nmore\n~~~"]
    row = spark.createDataFrame([(text,)], "t string").select(T.numbered_lists(F.col("t")).alias("n"), T.bullet_lists(F.col("t")).alias("b"), T.fences(F.col("t")).alias("f")).first()
    assert (row.n, row.b, row.f) == (["1. one\n2. two\n"], ["- a\n* b\n"], ["```\ncode\n```", "~~~\nmore\n~~~"])
    heads = [("## Head  \nx", "Head"), ("#no", None), ("text\n# Late", None), ("####### seven", None), ("# One", "One")]
    got = spark.createDataFrame(heads, "t string, h string").select("t", "h", T.first_header(F.col("t")).alias("g")).collect()
    assert all(r.h == r.g == C.opening_header(r.t) for r in got)
    parts = spark.createDataFrame([("## a## b",), ("x## ",), ("none",)], "t string").select(T.split_keeping(F.col("t"), "## ").alias("p")).collect()
    assert [r.p for r in parts] == [["## a", "## b"], ["x", "## "], ["none"]]
    inside = spark.sql("SELECT array(named_struct('start', 2, 'end', 5)) AS r, explode(array(1, 2, 4, 5)) AS p").select(T.in_ranges(F.col("p"), F.col("r")).alias("i")).collect()
    assert [r.i for r in inside] == [False, True, True, False]


def test_uuid5_is_the_standard_one(spark):
    names = ["a", "ä:1:x", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.uuid5(T.CHUNK_NAMESPACE, F.col("n")).alias("u"), T.document_id(F.lit("s"), F.col("n"), F.lit(None).cast("string")).alias("d")).collect()
    for r in got:
        assert r.u == str(uuid.uuid5(uuid.UUID(T.CHUNK_NAMESPACE), r.n))
        assert r.d == str(uuid.uuid5(uuid.UUID(T.DOCUMENT_NAMESPACE), f"s:{r.n}:default"))


def test_overlap_takes_sentences_then_lines_then_words():
    assert C.overlap_tail("short", 10) == "short" and C.overlap_tail("x", 0) == "" and C.overlap_tail("", 5) == ""
    assert C.overlap_tail("A long first sentence here. Second one. Third.", 5) == "Second one. Third."
    assert C.overlap_tail("line one is long\nline two\nline 3", 5) == "line two\nline 3"
    assert C.overlap_tail("x" * 30 + " y" + "z" * 17, 5) == "y" + "z" * 17
    assert C.overlap_tail("q" * 100, 5) == "q" * 20
    # the last unit is taken even if it is too long
    assert C.overlap_tail("Short. " + "w" * 30 + ".", 5) == "w" * 30 + "."


def test_small_spans_join_but_headings_wait():
    span = lambda *texts: [C.Span(t, 0, len(t)) for t in texts]
    joined = lambda *texts: [s.text for s in C.join_small(span(*texts), 5, 12)]
    assert joined("a" * 8, "b" * 24) == ["a" * 8 + "\n\n" + "b" * 24]
    assert joined("a" * 24, "# H") == ["a" * 24, "# H"]
    assert joined("a" * 24, "tail") == ["a" * 24 + "\n\ntail"]
    assert joined("a" * 8, "b" * 48) == ["a" * 8, "b" * 48]
    assert joined() == [] and joined("x") == ["x"]


def test_recursive_cuts_at_the_largest_separator():
    text = "# One\n\n" + "alpha beta. " * 12 + "\n## Two\n\n" + "gamma delta. " * 12
    pieces = C.recursive(text, C.ChunkerConfig(60, 0, 0, 80))
    assert all(len(p.text) <= 240 for p in pieces) and any(p.text.startswith("## Two") for p in pieces)
    assert "".join(C.tidy(text)[p.start : p.end] for p in pieces) == C.tidy(text)
    assert [len(p.text) for p in C.recursive("x" * 100, C.ChunkerConfig(10, 0, 0, 10))] == [40, 40, 20]
    for blank in ("", "  \n\t "):
        with pytest.raises(ValueError):
            C.recursive(blank)
    assert C.recursive("İ é 漢字 🙂")[0].text == "İ é 漢字 🙂"


def test_structure_keeps_fences_and_repeats_headings():
    code = "```py\nx = 1\n\n\ny = 2\n```"
    text = f"# Top\n\nintro.\n\n## Part\n\n{'Sentence number one. ' * 10}\n\n{code}\n\n- a\n- b"
    pieces = C.by_structure(text, C.ChunkerConfig(50, 0, 0, 100))
    assert any("x = 1\n\ny = 2" in p.text and p.has_code_block for p in pieces)
    assert [p.is_summary_chunk for p in pieces] == [True] + [False] * (len(pieces) - 1)
    assert sum(p.text.startswith("## Part") for p in pieces) > 1 and pieces[0].section_header == "Top"
    long = C.by_structure("## H\n\n" + "Some words in a sentence. " * 60, C.ChunkerConfig(50, 0, 0, 60))
    assert all(p.text.startswith("## H") for p in long) and all(len(p.text) <= 240 for p in long)
    assert [s.header for s in C.sections("a\n# b\n## c\ntext")] == ["", "b", "c"]
    assert [s.header for s in C.sections("# b\n\n# c")] == ["b", "c"]


def test_issue_summary_and_long_titles():
    pieces = C.issue("Crash", "First para.\n\nSecond para.")
    assert [p.text for p in pieces] == ["# Crash\n\nFirst para.", "Second para."] and pieces[0].is_summary_chunk
    assert [p.text for p in C.issue("Only", "  ")] == ["# Only"]
    assert C.issue("", "body")[0].text == "body"
    long = C.issue("T" * 300, "Para one.\n\nRest.", SMALL)
    assert long[0].text == "# " + "T" * 300 and "Para one." in long[1].text
    with pytest.raises(ValueError):
        C.issue("", "")


def test_comments_merge_by_author_under_the_cap():
    c = C.Comment
    two = C.merge_comments([c("a", "x", "1"), c("a", "y", "2"), c("b", "z", "3")], 100)
    assert two == [c("a", "x\n\n---\n\ny", "1"), c("b", "z", "3")]
    assert len(C.merge_comments([c("a", "x" * 50), c("a", "y" * 50)], 100)) == 2
    pieces = C.thread([c("a", "hello", "1"), c("a", "again", "2"), c("b", "other", "3")])
    assert [p.text for _, p in pieces] == ["**Comment by @a:**\n\nhello\n\n---\n\nagain", "**Comment by @b:**\n\nother"]
    assert len(C.thread([c("a", "hello"), c("a", "again"), c("b", "other")], merge_same_author=False)) == 3
    assert C.thread([]) == []


def test_threads_over_dataframes_equal_the_fold(spark):
    rng = random.Random(0)
    rows = [(k % 7, k, rng.choice("ab"), "word " * rng.randint(0, 60)) for k in range(120)]
    got = C.chunk_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SMALL).collect()
    for conv in range(7):
        fold = C.thread([C.Comment(r, t, str(k)) for c, k, r, t in rows if c == conv], SMALL)
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.chunk_index)
        assert [(r.comment_id, r.author, r.chunk_text) for r in mine] == [(c.comment_id, c.author, p.text) for c, p in fold]
        assert [r.chunk_index for r in mine] == list(range(len(mine)))


def test_semantic_cuts_where_meaning_changes():
    text = "Cats purr softly. Cats sleep a lot. Cats chase mice. Stocks rose today. Stocks fell later. Stocks closed flat."
    topic = lambda texts: np.array([[1.0, 0.0] if "Cats" in t else [0.0, 1.0] for t in texts])
    pieces = C.semantic(text, C.SemanticConfig(64, 0, 0, 64), topic)
    assert [p.text.split()[0] for p in pieces] == ["Cats", "Stocks"]
    assert len(C.semantic("One. Two.", C.SemanticConfig(), topic)) == 1
    packed = C.semantic(text, C.SemanticConfig(10, 0, 0, 10))
    assert len(packed) > 1 and " ".join(p.text for p in packed) == text
    assert C.neighbourhoods(["a", "b", "c"], 2) == ["a b", "a b c", "b c"]
    assert C.breakpoints([0.1, 0.1, 0.9, 0.1], C.SemanticConfig()) == {1, 3}
    assert C.cosines(np.array([[1, 0], [0, 0], [1, 1.0]])).tolist() == [0, 0]


def test_hybrid_chooses_by_structure(spark):
    md = "# A\n\ntext\n\n# B\n\nmore text"
    assert C.well_structured(md) and not C.well_structured("plain text only") and not C.well_structured("# A\n\n# B\n\n```\n" + "x" * 200 + "\n```")
    rows = C.chunk_documents(spark.createDataFrame([(1, md, "markdown_doc"), (2, "plain", "markdown_doc"), (3, "p", "other"), (4, " ", None), (5, None, None)], "doc_id long, text string, kind string"), source_col="kind").collect()
    assert {r.doc_id: r.strategy for r in rows if r.doc_id < 4} == {1: "hybrid:structure_aware", 2: "hybrid:recursive", 3: "recursive"}
    assert {r.doc_id for r in rows if r.error} == {4, 5}
    assert all(r.chunk_id and len(r.chunk_hash) == 64 for r in rows if not r.error)


def test_registry(spark):
    registry = C.Registry()
    registry.register("mine", "shout", lambda text, config: [C.Piece(text.upper(), 1)])
    rows = C.chunk_documents(spark.createDataFrame([(1, "hi", "mine")], "doc_id long, text string, s string"), source_col="s", registry=registry).collect()
    assert rows[0].chunk_text == "HI"
    with pytest.raises(ValueError):
        registry.get("none")


@pytest.mark.parametrize("seed", range(8))
def test_pieces_cover_random_markdown(seed):
    rng = random.Random(seed)
    block = lambda: rng.choice(["# H", "## Sub head", "- a\n- b", "1. x\n2. y", "word " * rng.randint(1, 80), "Sent one. Two! " * rng.randint(1, 20), "```\ncode\n```", "y" * 300])
    text = "\n\n".join(block() for _ in range(rng.randint(1, 25)))
    seen = lambda t: re.sub(r"\s+", "", t)
    for chunker in (C.recursive, C.hybrid, C.by_structure):
        config = C.ChunkerConfig(40, 0, 10, 60)
        pieces = chunker(text, config)
        whole = seen("".join(p.text for p in pieces))
        # nothing is lost; headings may be repeated
        it = iter(whole)
        assert all(ch in it for ch in seen(text))
        assert chunker(text, config) == pieces
