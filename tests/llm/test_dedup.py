"""Exact, line and near deduplication against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import exact_dedup, line_dedup, simhash
from tests.llm.helpers import corpus, documents, words


def test_exact_groups(spark):
    rows = corpus()
    got = {r.id: r for r in exact_dedup.exact_groups(documents(spark, rows)).collect()}
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for i, t in rows:
        ids = by[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
        assert got[i].digest == hashlib.sha256((t or "").encode()).digest()


def test_exact_clashing_digests_are_told_apart_by_bytes(spark):
    rows = corpus(30)
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))  # noqa: E731  16 digests for all texts
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(documents(spark, rows), digest=weak).collect()}
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    assert got == {i: (max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""])) for i, t in rows}


def test_exact_repeated_rows_null_ids_and_empty(spark):
    docs = documents(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")])
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 3
    assert {r.keep_id for r in rows if r.group_size == 3} == {1}
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    assert exact_dedup.drop_exact(documents(spark, [])).columns == docs.columns


def test_exact_state_lasts_over_arrivals(spark, tmp_path):
    log = exact_dedup.DedupLog(spark, f"file://{tmp_path}/log")
    log.append(documents(spark, [(1, "a"), (2, "b")]))
    log.update()
    log.append(documents(spark, [(5, "a"), (3, "c")]))
    log.update()
    state = {r.digest: (r.n, r.keep.id) for r in log.state().collect()}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    assert state == {digest("a"): (2, 5), digest("b"): (1, 2), digest("c"): (1, 3)}
    assert log.log().select("locator").distinct().count() == 4
    texts = {r.keep.id: r.text for r in log.fetch(log.state()).collect()}
    assert texts == {5: "a", 2: "b", 3: "c"}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_bytes_are_compared_over_arrivals(spark, tmp_path, weak):
    """Forced clashes between texts of several arrivals, some of them plain file scans."""
    digest = (lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))) if weak else exact_dedup.sha256
    rng, seen, root = random.Random(3), [], f"file://{tmp_path}/log"
    for arrival in range(4):
        rows = [(rng.randint(1, 10**6), rng.choice(["old text", "different", "third", "", None, f"text {rng.randint(0, 40)}"])) for _ in range(25)]
        docs = documents(spark, rows)
        if arrival % 2:
            docs.write.parquet(f"file://{tmp_path}/arrival {arrival}")
            docs = spark.read.parquet(f"file://{tmp_path}/arrival {arrival}")
        seen += rows
        got = exact_dedup.exact_groups(docs, root=root, digest=digest).collect()
        by = {}
        for i, t in seen:
            by.setdefault(t or "", []).append(i)
        assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got) == sorted((i, max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""])) for i, t in rows)


@pytest.mark.parametrize("scan", [False, True])
def test_exact_an_arrival_given_again_counts_once(spark, tmp_path, scan):
    """After a failure before the update, after it, and after everything."""
    root = f"file://{tmp_path}/log"
    docs = documents(spark, [(1, "a"), (2, "b")])
    if scan:
        docs.write.parquet(f"file://{tmp_path}/docs")
        docs = spark.read.parquet(f"file://{tmp_path}/docs")
    log = exact_dedup.DedupLog(spark, root)
    log.append(docs, name="monday")
    for _ in range(2):
        rows = exact_dedup.exact_groups(docs, root=root, name="monday").collect()
        assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in rows) == [(1, 1, 1, True), (2, 2, 1, True)]
    # what a failed writer left behind is written anew: its number is taken, its log is not there
    log._number("tuesday")
    (tmp_path / "log" / "content" / "2").mkdir(parents=True)
    rows = exact_dedup.exact_groups(documents(spark, [(7, "a"), (8, None)]), root=root, name="tuesday").collect()
    assert sorted((r.id, r.keep_id, r.group_size) for r in rows) == [(7, 7, 2), (8, 8, 1)]
    assert log._number("monday") == 1 and log._number("tuesday") == 2 and log._number("wednesday") == 3
    # two writers that saw the same newest number
    assert not log._claim("numbers/000000003", "late")


def test_exact_drop_keeps_columns_and_texts(spark):
    rows = corpus()
    docs = documents(spark, rows)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in rows})


def lines_truth(rows, least=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(fold)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def test_line_dedup(spark):
    rows = corpus()
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    truth = lines_truth(rows)
    assert got == truth and any(n for _, _, n in truth.values())


def test_line_dedup_threshold_and_awkward_rows(spark):
    rows = [(1, "a common line here\nx"), (2, "a common line here"), (3, "A COMMON LINE HERE\n\n"), (4, "pair of documents"), (5, "pair of documents")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows), min_docs=3).collect()}
    assert got == {1: "a common line here\nx", 2: "", 3: "\n", 4: "pair of documents", 5: "pair of documents"}
    again = line_dedup.dedup_lines(documents(spark, [(1, "the same line twice"), (1, "the same line twice"), (None, "the same line twice")])).collect()
    assert [(r.doc_id, r.n_dropped) for r in sorted(again, key=lambda r: r.doc_id or 0)] == [(None, 0), (1, 0), (1, 0)]
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0
    clash = documents(spark, rows).withColumns({"N_LINES": F.lit("mine"), "n_dropped": F.lit("mine too")})
    out = line_dedup.dedup_lines(clash)
    assert out.columns == [*clash.columns, "n_lines_", "n_dropped_"]
    assert {(r.N_LINES, r.n_dropped, r.n_dropped_) for r in out.where("doc_id = 2").collect()} == {("mine", "mine too", 1)}


def fingerprint(text, width=3):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    shingles = [" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_hashes_of_ranges():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    size = np.concatenate([np.arange(700), rng.integers(0, 60, 2000)])
    start = rng.integers(0, len(data) - size + 1)
    for seed in (0, 42, 2**64 - 1):
        expected = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed) for a, n in zip(start, size, strict=True)]
        assert simhash.xxh64(data, start, size, seed).tolist() == expected
    assert simhash.xxh64(data, start[:0], size[:0], 1).tolist() == []


def test_fingerprints_over_blocks(monkeypatch):
    texts = [t for _, t in corpus()] + ["w" * 3000 + " x y", "ab " * 5000, None, ""]
    monkeypatch.setattr(simhash, "BLOCK", 97)
    assert simhash._fingerprints(pa.array(texts), 3, 42).tolist() == [fingerprint(t) for t in texts]


def test_fingerprint_of_a_very_long_text():
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{k}" * (1 + k % 4) for k in range(3000)])
    text = " ".join(vocabulary[rng.integers(0, 3000, 2_500_000)])
    assert len(text) > 20_000_000
    assert simhash._fingerprints(pa.array([text, "a b c d"]), 3, 42).tolist() == [fingerprint(text), fingerprint("a b c d")]


def groups_truth(prints):
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_of_texts(spark):
    rows = corpus()
    got = {r.id: (r.fp % 2**64, r.component_id) for r in simhash.near_groups(documents(spark, rows)).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    truth = groups_truth(prints)
    assert got == {i: (prints[i], truth[i]) for i in prints}
    assert simhash.near_groups(documents(spark, [])).count() == 0


def test_links_and_components_lose_nothing(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    values = set(seeds)
    for s in seeds:  # chains of near fingerprints, so components are wider than one link
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                s ^= 1 << b
            values.add(s)
    values = sorted(values)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    links = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.hamming_links(spark.createDataFrame(signed, "fp long")).collect()}
    truth = {(a, b) for k, b in enumerate(values) for a in values[:k] if bin(a ^ b).count("1") <= 3}
    assert links == truth
    pairs = spark.createDataFrame([(i, j) for i, a in enumerate(values) for j in [k for k, b in enumerate(values) if k < i and (b, a) in truth]], "a long, b long")
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    expected = groups_truth(dict(enumerate(values)))
    assert all(expected[i] == root for i, root in got.items())
    assert {i for i, r in expected.items() if r != i} <= set(got)


@pytest.mark.parametrize("seed", range(3))
def test_dense_entries_keep_all_components(spark, seed):
    rng = random.Random(seed)
    values = set()
    for _ in range(3):  # clouds around centres that agree in a half, and strays
        centre = rng.getrandbits(64)
        for _ in range(70):
            v = centre
            for b in rng.sample(range(rng.choice([0, 32]), 64), rng.randint(0, 6)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values | {rng.getrandbits(64) for _ in range(40)})
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    links = simhash.hamming_links(spark.createDataFrame(signed, "fp long"), dense=2).collect()
    near = [(a % 2**64, b % 2**64) for a, b in links]
    assert all(1 <= bin(a ^ b).count("1") <= 3 for a, b in near)
    place = {v: k for k, v in enumerate(values)}
    root = dict(place)
    for _ in values:  # components of the links
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    truth = groups_truth({place[v]: v for v in values})
    assert {place[v]: r for v, r in root.items()} == truth and len(set(truth.values())) < len(values)


def test_long_chain_of_links_settles(spark):
    n = 300
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n + 1), 0)


def test_drops_go_by_row(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long), (1, long), (1, long), (2, long), (None, "no id"), (None, "no id"), (None, "p q"), (3, "r s"), (3, "t u"), (4, "t u")]
    docs = documents(spark, rows)
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    for options in ({}, {"digest": weak}):
        kept = exact_dedup.drop_exact(docs, **options)
        assert kept.columns == docs.columns
        assert found(kept) == sorted([(2, long), (None, "no id"), (None, "p q"), (3, "r s"), (4, "t u")], key=str)
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    assert found(kept) == sorted([(1, long), (None, "no id"), (None, "p q"), (3, "r s"), (3, "t u")], key=str)
