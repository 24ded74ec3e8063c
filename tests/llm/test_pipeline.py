"""The pipeline and the registered queries on the smallest tables, against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from quern.llm import gam, mixing
from quern.llm.queries import LEVELS, QUERIES
from tests.conftest import SF
from tests.llm.helpers import words
from tests.llm.test_dedup import fingerprint, groups_truth, lines_truth
from tests.llm.test_models import counts_truth


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The output of each stage, written and read again as the driver does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, str(SF)).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert len(stages) in (4, 5) and all(s.columns == columns for s in stages[:-1])


def test_classifier_stage(spark, stages):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    score = {r.id: r.score for r in gam.classify(docs, labels).collect()}
    kept = rows_of(stages[0])
    assert set(kept) == {i for i, s in score.items() if s >= 0.5}
    assert all(kept[i] == r for i, r in rows_of(docs).items() if i in kept)


def test_exact_stage(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    newest = {}
    for i, r in before.items():
        newest[r.text] = max(i, newest.get(r.text, i))
    assert set(after) == set(newest.values())


def test_near_stage(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    groups = groups_truth({i: fingerprint(r.text) for i, r in before.items()})
    assert set(after) == set(groups.values())


def test_mixing_stage(stages):
    before, drawn = rows_of(stages[2]), stages[3].collect()
    size = {i: len(words(r.text)) for i, r in before.items()}
    times = defaultdict(int)
    for r in drawn:
        assert before[r.doc_id].text.startswith(r.text) and r[2:] == before[r.doc_id][2:]
        times[r.doc_id] += 1
    assert sum(len(words(r.text)) for r in drawn) == sum(size.values()) * 3 // 5
    leaves = {(r.lang, r.source) for r in before.values()}
    assert sum(r.text != before[r.doc_id].text for r in drawn) <= len(leaves) and max(times.values()) <= 4


def test_packing_stage(stages):
    """Put together again, the pieces of the drawn documents are their tokens."""
    import base64
    from collections import Counter

    import tiktoken

    public_tokenizers = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    truth = tiktoken.Encoding("truth", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for r in stages[3].collect():
        ids = [*truth.encode_ordinary(r.text), 50256]
        expected.update((r.doc_id, k, tuple(ids[k : k + 4096])) for k in range(0, len(ids), 4096))
    got = Counter()
    for r in stages[4].collect():
        assert len(r.tokens) == r.bin_used <= r.bin_length
        for i, start, a, b in zip(r.doc_ids, r.piece_starts, r.bin_starts, [*r.bin_starts[1:], r.bin_used], strict=True):
            got[i, start, tuple(r.tokens[a:b])] += 1
    assert got == expected


def test_run_is_the_stages(spark, stages):
    key = lambda df: sorted((i, n) for r in df.collect() for i, n in zip(r.doc_ids, r.piece_starts, strict=True))
    assert key(corpus_pipeline.run(spark, str(SF))) == key(stages[4])


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names


def test_line_query(spark, documents):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op2_line_dedup"](spark, str(SF)).collect()}
    assert got == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (t, n, d) in lines_truth(documents).items()}


def test_rules_query(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, str(SF)).collect()}
    for i, t in documents:
        r = got[i]
        counts = counts_truth(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and (not r.base_failed or not r.kept)


def test_token_query(spark, documents):
    import numpy as np

    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_files"](spark, str(SF)).collect()}
    start = 0
    for i, t in sorted(documents):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_simhash_query(spark, documents):
    prints = {i: fingerprint(t) for i, t in documents}
    groups = groups_truth(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_near_dedup"](spark, str(SF)).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


def test_exact_query(spark, documents):
    groups = defaultdict(list)
    for i, t in documents:
        groups[t].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op8_exact_dedup"](spark, str(SF)).collect()}
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in documents}


def test_classifier_query(spark):
    rows = QUERIES["op9_quality_classifier"](spark, str(SF)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


AWKWARD = [(None, None, None, None, None), (None, "no id", "en", None, 5), (1, None, "en", "src0", None), (1, None, "en", "src0", None), (2, "", None, "src1", 0), (3, "same text " * 30, "de", "src1", 1), (4, "same text " * 30, "de", "src1", 1), (5, "w " * 9000, "xx", "", 2)]


@pytest.mark.parametrize("rows", [[], AWKWARD], ids=["empty", "awkward"])
def test_every_stage_takes_awkward_tables(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "fp", "n") for r in rows], f"{schema}, fp string, __id string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        found = out.collect()
        assert (len(found) == 0) if not rows else True
    if rows:
        assert {r.doc_id for r in corpus_pipeline.exact(spark, docs, str(SF)).collect()} == {None, 2, 4, 5}
        near = corpus_pipeline.near(spark, docs, str(SF)).collect()
        assert {r.doc_id for r in near} >= {None, 1, 3, 5} and 4 not in {r.doc_id for r in near}
        # with the whole budget, every row that has words is drawn, whatever its id
        drawn = mixing.draw(docs, LEVELS, {}, share=(1, 1), max_epochs=1).collect()
        assert sorted(map(str, drawn)) == sorted(str(r) for r in docs.collect() if words(r.text))
