"""Tokenizer alignment against plain Python over the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quern.llm import alignment
from tests.llm.helpers import corpus, documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def sample():
    rng = random.Random(2)
    odd = ["<|endoftext|> <s> </s> <unk> <0x41>", "  two  blanks\t\ttabs\n\nlines \r\n", "naïve café “quotes” — dash… 😀👩‍👩‍👧 日本語テキスト", "a\x00b\x01", "x" * 3000, "ﬁ ﬀ ｆｕｌｌ ① ² İ", "▁ under ▁▁x", " lead", "trail ", " nbsp em　ideographic\x85nel ", "don't we'll I'VE 12,345.67"]
    rows = corpus(30, 4) + [(200 + k, t) for k, t in enumerate(odd)] + [(200, odd[0]), (None, odd[2])]
    kinds = [range(32, 127), range(0xA0, 0x250), range(0x370, 0x530), range(0x4E00, 0x4E80), range(0x1F300, 0x1F5FF), range(0, 32), range(0x2000, 0x2070)]
    return rows + [(300 + k, "".join(chr(rng.choice(rng.choice(kinds))) for _ in range(rng.randint(1, 120)))) for k in range(60)]


def truth(rows, libraries):
    a, b = libraries
    spec = json.load(open(A))
    alphabet = {c: i for c, i in zip([chr(x) for x in range(33, 127)], range(33, 127), strict=True)}
    free = 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            alphabet[chr(x)] = x
        else:
            alphabet[chr(free)] = x
            free += 1
    text_of = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t != "<|endoftext|>"}
    docs, held = [], Counter()
    for i, text in rows:
        empty = dict(id=i, n_a=0, n_b=0, n_groups=0, n_links=0, links=[], digest="")
        if not text:
            docs.append(empty)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pa_ = [text_of[x] for x in ia]
        pb = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ib for p in [b.id_to_piece(x)]]
        if b"".join(pa_) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            docs.append(empty)
            continue
        spans = []
        for ids, parts in ((ia, pa_), (ib, pb)):
            at, out = 0, []
            for x, part in zip(ids, parts, strict=True):
                out.append((at, at + len(part), x))
                at += len(part)
            spans.append(out)
        links, k = [], 0
        for s, e, x in spans[0]:
            while k and spans[1][k - 1][1] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    links.append((x, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for s, e, x in side if before < e <= c) for side in spans))
            before = c
        held.update(set(links))
        docs.append(dict(id=i, n_a=len(ia), n_b=len(ib), n_groups=len(cuts), n_links=len(links), links=links, groups=groups, digest=hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for d in docs:
        d["n_best"] = sum(held[p] == most[p[0]] for p in d["links"])
        d["count_sum"] = sum(held[p] for p in d["links"])
    return docs


FIELDS = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.mark.parametrize("sizes", [{}, {"range_pairs": 40, "salt_bytes": 1500}])
def test_link_statistics_against_brute_force(spark, libraries, sizes):
    rows = sample()
    shipped = alignment.tokenizers(spark, A, B, public_tokenizers.PATTERN)
    got = [(*(r[f] for f in FIELDS), r.digest.hex() if r.digest is not None else "") for r in alignment.link_statistics(documents(spark, rows), shipped, **sizes).collect()]
    want = [(*(d[f] for f in FIELDS), d["digest"]) for d in truth(rows, libraries)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[1] == 0 and w[0] is not None and w[0] >= 200 for w in want) and sum(w[1] > 0 for w in want) > 60


def test_groups_and_products(spark, libraries):
    rows = sample()
    shipped = alignment.tokenizers(spark, A, B, public_tokenizers.PATTERN)
    groups = alignment.aligned_groups(documents(spark, [r for r in rows if r[0] is not None and r[0] > 200]), shipped)
    by = defaultdict(list)
    for r in groups.collect():
        by[r.id].append((r.group, r.start, r.end, ",".join(map(str, r.a)) + "|" + ",".join(map(str, r.b))))
    want = {d["id"]: d["groups"] for d in truth([r for r in rows if r[0] is not None and r[0] > 200], libraries) if d["n_a"]}
    assert {i: [g[3] for g in sorted(x)] for i, x in by.items()} == want
    for x in by.values():
        assert [g[1] for g in sorted(x)] == [0, *(g[2] for g in sorted(x)[:-1])]
    n = sum((len(r.a) * len(r.b)) for r in groups.collect())
    assert alignment.group_products(groups).count() == n


def test_no_documents(spark):
    shipped = alignment.tokenizers(spark, A, B, public_tokenizers.PATTERN)
    assert alignment.link_statistics(documents(spark, []), shipped).count() == 0
    rows = alignment.link_statistics(documents(spark, [(1, None), (2, "")]), shipped).collect()
    assert sorted((r.id, r.n_links, r.count_sum, r.digest) for r in rows) == [(1, 0, 0, None), (2, 0, 0, None)]


def test_the_ranks_of_the_file_split_all_characters_as_its_own_library(libraries):
    """Every character, beside letters, digits, blanks and marks."""
    side = alignment.ByteTokens(open(A, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(1)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(points)
    texts = ["".join(chr(c) + rng.choice(["", "a", "1", " ", ".", "é", "\n"]) for c in points[k : k + 400]) for k in range(0, len(points), 400)]
    theirs = libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert [list(x) for x in side.encode(texts)] == [e.ids for e in theirs]


def test_the_registered_query_over_its_whole_table(spark, libraries):
    from quern.llm.queries import QUERIES
    from tests.conftest import SF

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op11_tokenizer_alignment"](spark, str(SF))
    assert got.columns == ["doc_id", *FIELDS[1:], "groups_sha256"]
    want = [(*(d[f] for f in FIELDS), d["digest"]) for d in truth(rows, libraries)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
