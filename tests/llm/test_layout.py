"""Mixing, packing, token files, sharding and chat formatting."""

from __future__ import annotations

import hashlib
import io
import itertools
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from quern.llm import chat, mixing, packing, sharding, token_files
from quern.llm.shared import scratch_path
from tests.llm.helpers import corpus, documents, words

public_tokenizers = pytest.importorskip("public_tokenizers")

# ---------------------------------------------------------------- mixing


def fill(budget, children):
    """Water-filling by definition: hand out in proportion, take back what a child cannot hold, again."""
    share, open_ = {}, dict(children)
    left = Fraction(budget)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [c for c, (w, cap) in open_.items() if left * w / total >= cap]
        if not full:
            for c, (w, _) in open_.items():
                share[c] = left * w / total
            break
        for c in full:
            share[c] = Fraction(open_[c][1])
            left -= open_.pop(c)[1]
    return share


LEVELS = {"domain": "CASE WHEN length(source) <= 4 THEN 'near' ELSE 'far' END", "lang": "lang", "source": "source"}
WEIGHTS = {("near",): 3, ("near", "en"): 4, ("far", "de"): 2, ("near", "en", "src0"): 5}


@pytest.mark.parametrize("share,epochs", [((1, 2), 1), ((3, 5), 4), ((1, 1), 1), ((2, 1), 2), ((5, 1), 3)])
def test_budgets_and_prefixes(spark, share, epochs):
    docs = documents(spark, corpus(80))
    rows = mixing.mix(docs, LEVELS, WEIGHTS, share=share, max_epochs=epochs, seed=9).collect()
    base = [(r.doc_id, "near" if len(r.source) <= 4 else "far", r.lang or "(null)", r.source, len(words(r.text))) for r in docs.collect()]
    held = defaultdict(int)
    for _, *leaf, n in base:
        held[tuple(leaf)] += n
    total = sum(held.values()) * share[0] // share[1]
    budget = {(): Fraction(min(total, epochs * sum(held.values())))}
    for depth in (1, 2, 3):
        caps = defaultdict(int)
        for leaf, n in held.items():
            caps[leaf[:depth]] += n * epochs
        for parent in {c[:-1] for c in caps}:
            below = {c: (WEIGHTS.get(c, 1), cap) for c, cap in caps.items() if c[:-1] == parent}
            budget |= fill(budget[parent], below)
    taken = defaultdict(int)
    for r in rows:
        taken[r.domain, r.lang, r.source] += r.taken
    assert sum(taken.values()) == min(total, epochs * sum(held.values()))
    # whole-token rounding moves each level by less than one token a child
    assert all(abs(taken[leaf] - budget[leaf]) <= 8 for leaf in held)
    for leaf in held:
        mine = sorted((r for r in rows if (r.domain, r.lang, r.source) == leaf), key=lambda r: (r.epoch, r.order_key, r.id))
        sizes = {i: n for i, *x, n in base if tuple(x) == leaf and n}
        passes, prefix = divmod(taken[leaf], held[leaf]) if held[leaf] else (0, 0)
        expected = [(e, i, sizes[i]) for e in range(passes) for i in sizes]
        for i in sorted(sizes, key=lambda i: (hashlib.md5(f"9:{passes}:{i}".encode()).hexdigest(), i)):
            if prefix > 0:
                expected.append((passes, i, min(prefix, sizes[i])))
                prefix -= min(prefix, sizes[i])
        assert sorted((r.epoch, r.id, r.taken) for r in mine) == sorted(expected)


def test_mixing_awkward_inputs(spark):
    assert mixing.mix(documents(spark, []), LEVELS, WEIGHTS).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, "")]), LEVELS, WEIGHTS).count() == 0
    same = mixing.mix(documents(spark, [(1, "a b c")] * 5 + [(None, "d e")]), LEVELS, WEIGHTS, share=(1, 1), max_epochs=1).collect()
    assert sum(r.taken for r in same) == 17
    with pytest.raises(ValueError):
        mixing.mix(documents(spark, [(1, "a")]), LEVELS, {("near",): 0})
    assert spark.range(1).select(mixing.prefix_text(F.lit(" a\tb\n c"), F.lit(2)).alias("t")).first().t == " a\tb"


def test_mixing_draw_keeps_columns_and_repeats(spark):
    docs = documents(spark, corpus(30))
    drawn = mixing.draw(docs, LEVELS, WEIGHTS, share=(2, 1), max_epochs=3)
    assert drawn.columns == docs.columns
    assert drawn.groupBy("doc_id").count().agg(F.max("count")).first()[0] > 1


@pytest.mark.parametrize("share", [(1, 4), (3, 5), (1, 1), (7, 4)])
def test_a_draw_takes_the_tokens_of_the_mix(spark, share, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 2)
    rows = corpus(40) + [(None, "no id at  all"), (None, "nor\there")] + [(7, "x y  z w")] * 30 + [(7, f"seven {k}") for k in range(9)]
    docs = documents(spark, rows)
    mixed = mixing.mix(docs, LEVELS, WEIGHTS, share=share, max_epochs=2).collect()
    drawn = mixing.draw(docs, LEVELS, WEIGHTS, share=share, max_epochs=2).collect()
    assert sum(r.taken for r in mixed) == sum(len(words(r.text)) for r in drawn) == sum(len(words(t)) for _, t in rows) * share[0] // share[1]
    assert Counter((r.id, r.taken) for r in mixed) == Counter((r.doc_id, len(words(r.text))) for r in drawn)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    cut = [r for r in drawn if r.text not in texts[r.doc_id]]
    assert len(cut) == sum(r.taken < r.n_tokens for r in mixed) and all(any(t.startswith(r.text) for t in texts[r.doc_id]) for r in cut)


# ---------------------------------------------------------------- packing


RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pack(docs, **options):
    return packing.pack(docs, RANKS, 50256, public_tokenizers.PATTERN, **options)


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_whole_and_fits(spark, seed):
    """Every document's pieces, put together again, are its tokens."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    truth = tiktoken.Encoding("truth", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(seed)
    rows = [(i, " ".join(["w é<|endoftext|>"[: rng.randint(1, 16)]] * rng.choice([0, 1, 5, 30, 63, 64, 65, 200, 700]))) for i in range(300)] + [(301, "again"), (None, "x y"), (400, None), (401, "z" * 3000)]
    lengths = (64, 128, 256)
    found = pack(documents(spark, rows), lengths=lengths, shard_items=100).collect()
    got = defaultdict(list)
    for r in found:
        assert r.bin_used == len(r.tokens) and r.bin_length == min(c for c in lengths if c >= r.bin_used)
        ends = [*r.bin_starts[1:], r.bin_used]
        assert r.bin_starts[0] == 0 and r.bin_starts == sorted(r.bin_starts)
        for i, start, a, b in zip(r.doc_ids, r.piece_starts, r.bin_starts, ends, strict=True):
            got[i].append((start, r.tokens[a:b]))
    assert {i: [t for _, part in sorted(parts) for t in part] for i, parts in got.items()} == {i: [*truth.encode_ordinary(t or ""), 50256] for i, t in rows}
    assert len({r.shard for r in found}) > 1
    places = packing.placements(pack(documents(spark, rows), lengths=lengths, shard_items=100))
    assert places.count() == sum(len(r.doc_ids) for r in found)
    same = pack(documents(spark, [(7, "a b c")] * 50 + [(None, "a")] * 3)).collect()
    assert Counter(i for r in same for i in r.doc_ids) == {7: 50, None: 3}


def naive_best_fit(sizes, lengths, cost, floor):
    """By looking at every open bin for every item; of equally tight bins the one that was filled last."""
    bins = []
    for k, item in enumerate(sizes):
        fits = [b for b in bins if b[0] - b[1] >= item]
        if fits:
            bin_ = min(fits, key=lambda b: (b[0] - b[1], -b[2]))
        else:
            bin_ = [min((c for c in lengths if c >= max(item, floor)), key=lambda c: (cost(c) / c, c)), 0, k]
            bins.append(bin_)
        bin_[1:] = bin_[1] + item, k
    return sorted(used for _, used, _ in bins)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_against_brute_force(seed):
    rng = random.Random(seed)
    lengths, cost = [25, 50, 100], packing.Cost(rng.choice([0, 3, 10]), rng.choice([40, 10**9]))
    sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 80))), reverse=True)
    plans = [naive_best_fit(sizes, lengths, cost, floor) for floor in lengths]
    final = lambda used: next(c for c in lengths if c >= used)
    for floor, plan in zip(lengths, plans, strict=True):
        where, start, used = packing.best_fit(sizes, lengths, cost, floor)
        assert sorted(used) == plan
        inside = defaultdict(list)
        for w, s, n in zip(where, start, sizes, strict=True):
            inside[w].append((s, n))
        assert all([s for s, _ in x] == [0, *itertools.accumulate(n for _, n in x)][:-1] for x in inside.values())
    where, start, used, ends = packing.plan_bins(sizes, lengths, cost)
    assert ends == [final(u) for u in used]
    assert sum(map(cost, ends)) == pytest.approx(min(sum(cost(final(u)) for u in plan) for plan in plans))


def test_best_fit_takes_the_tightest_bin():
    cost = packing.Cost(10, 10**9)
    where, start, used = packing.best_fit([60, 50, 40, 30, 10], [100], cost, 100)
    assert (where, start, used) == ([0, 1, 0, 1, 1], [0, 0, 60, 50, 80], [100, 90])
    assert packing.plan_bins([], [25], cost) == ([], [], [], [])


def test_packing_of_nothing(spark):
    assert pack(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- token files

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("tokenizer,item", [(WORD_BPE, 2), (WORD_BPE, 4), (BYTE_BPE, 2)])
def test_token_files_round_trip(spark, tokenizer, item):
    from tokenizers import Tokenizer

    rows = corpus(40) + [(5, "a repeated id"), (None, "no id at all")]
    truth = Tokenizer.from_file(tokenizer)
    ids = lambda t: [*truth.encode(t or "", add_special_tokens=False).ids, 2]
    root = scratch_path(spark, "tokens")
    manifest = token_files.write_files(documents(spark, rows), tokenizer, root, item=item, frame_tokens=700)
    got = token_files.read_digests(manifest).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.id is not None, r.id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, len(ids(t)), crc(ids(t))) for i, t in rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    order = [r.id if r.id is not None else -1 for r in got]
    assert order == sorted(order)
    # random access: a document from its own frames only
    by_id = {i: t for i, t in rows}
    for f in manifest.collect():
        data = open(f.file.removeprefix("file://"), "rb").read()
        reader = token_files.Reader(io.BytesIO(data))
        row = len(reader.ids) - 1
        (found,) = reader.documents([row])
        if not reader.nulls[row] and reader.ids[row] != 5:
            assert found.tolist() == ids(by_id[int(reader.ids[row])])
            assert reader.decompressed <= 2 + len(found) // 700
        # the frames are ordinary zstandard
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
        assert len(plain.read()) == f.n_tokens * item


def test_ids_beyond_the_item_are_refused(spark, tmp_path):
    writer = token_files.Writer(io.BytesIO(), 2)
    writer.add(pa.array([1]), np.array([1, 70000], np.uint32), np.array([2]))
    with pytest.raises(ValueError, match="70000"):
        writer.close()
    with pytest.raises(ValueError):
        token_files.write_files(documents(spark, [(1, "a")]), WORD_BPE, f"file://{tmp_path}", end_id=70000, item=2)


def test_damage_is_found():
    sink = io.BytesIO()
    writer = token_files.Writer(sink, 4, 100)
    writer.add(pa.array([1, None, 3]), np.arange(1000, dtype=np.uint32), np.array([10, 500, 490]))
    assert writer.close() == 3
    data = bytearray(sink.getvalue())
    reader = token_files.Reader(io.BytesIO(bytes(data)))
    assert next(reader.documents([1])).tolist() == list(range(10, 510)) and reader.decompressed == 6
    data[int(reader.place[3]) + 12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.Reader(io.BytesIO(bytes(data))).documents([1]))
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(bytes(data[:-1])))


def test_token_files_of_nothing(spark):
    manifest = token_files.write_files(documents(spark, []), WORD_BPE, scratch_path(spark, "tokens"))
    assert manifest.count() == 0 and token_files.read_digests(manifest).count() == 0


# ---------------------------------------------------------------- sharding


def test_shards_are_tiered_merged_and_versioned(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(900)] + [(None, "null run"), (3, None), (3, None)]
    docs = documents(spark, rows)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=20_000, fanout=3, base_bytes=1000)
    assert store.append(docs, F.floor(F.col("doc_id") / 20)) == 1
    assert store.compact(docs.schema) == 2
    for version in (1, 2):
        got = store.read(docs.schema, version)
        assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted((i or -1, t or "") for i, t in rows)
        sizes = defaultdict(lambda: [0, 0])
        for r in got.collect():
            sizes[r.shard_id][0] += 1
            sizes[r.shard_id][1] += len(r.text or "")
        assert {r.shard_id: [r.n_rows, r.n_bytes] for r in store.manifest(version).collect()} == sizes
    merged = [r for r in store.manifest(2).collect() if r.shard_id.startswith("v2")]
    assert merged and max(r.n_bytes for r in merged) < 2 * 20_000
    assert store.manifest(2).count() < store.manifest(1).count()
    # arrivals after a compaction join the merged shards; old folders go with the vacuum
    assert store.append(documents(spark, [(5000, "late")]), F.lit(5000)) == 3
    store.vacuum()
    assert store.read(docs.schema).count() == len(rows) + 1


def test_a_commit_never_overwrites(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(documents(spark, [(1, "a")]), F.lit(0))
    with pytest.raises(Exception):  # noqa: B017  the file system's own error
        store._commit(store.manifest(1).drop("version"), 0)
    assert store.version() == 1


def test_two_writers_at_one_version(spark, tmp_path):
    """The writer that comes second fails and leaves the first one's rows as they are, in append and compact."""
    root, run = f"file://{tmp_path}/s", F.floor(F.col("doc_id") / 2)
    a, b = (sharding.ShardStore(spark, root, fanout=2) for _ in range(2))
    docs = documents(spark, [(i, "AAAA") for i in range(8)])
    b.version = lambda: 0
    a.append(docs, run)
    with pytest.raises(Exception):  # noqa: B017
        b.append(documents(spark, [(i, "BBBB") for i in range(8)]), run)
    assert [r.text for r in a.read(docs.schema).collect()] == ["AAAA"] * 8
    b.version = lambda: 1
    a.compact(docs.schema)
    with pytest.raises(Exception):  # noqa: B017
        b.compact(docs.schema)
    assert a.version() == 2 and [r.text for r in a.read(docs.schema).collect()] == ["AAAA"] * 8


def test_each_target_file_has_a_task_of_its_own(spark, tmp_path):
    docs = documents(spark, [(i, "x" * 400) for i in range(600)])
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=20_000, fanout=3, base_bytes=1000)
    store.append(docs, F.floor(F.col("doc_id") / 5), gather=True)
    store.compact(docs.schema)
    shards = store.manifest().collect()
    assert len(shards) > 9
    for r in shards:
        assert len(list((tmp_path / "s" / r.folder).glob("*.parquet"))) == 1
    tasks = {next((tmp_path / "s" / r.folder).glob("*.parquet")).name.split("-")[1] for r in shards}
    assert len(tasks) == len(shards)


def test_tiers_are_powers_of_four(spark):
    got = spark.createDataFrame([(0,), (999,), (1000,), (3999,), (4000,), (15999,), (16000,)], "b long").select("b", sharding.tier(F.col("b"), 1000).alias("t")).collect()
    assert [r.t for r in got] == [0, 0, 0, 1, 1, 2, 2]


def test_sharding_nothing(spark, tmp_path):
    docs = documents(spark, [])
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.manifest().count() == 0
    store.append(docs, F.col("doc_id"))
    assert store.version() == 1 and store.manifest().count() == 0
    assert store.compact(docs.schema) == 2


# ---------------------------------------------------------------- chat


def legal(roles):
    roles = roles[1:] if roles[:1] == [1] else roles
    return len(roles) % 2 == 0 and bool(roles) and roles == [2, 3] * (len(roles) // 2)


def cheapest(roles, costs, longest=4):
    """By trying every repair: for each turn keep or relabel or merge, with up to two empty turns before it."""
    best = chat.FAR
    fillers = [(), (2,), (3,), (2, 3), (3, 2)]
    stack = [(0, (), 0)]
    while stack:
        k, out, cost = stack.pop()
        if cost >= best or len(out) > len(roles) + longest:
            continue
        if k == len(roles):
            for extra in fillers:
                if legal([*out, *extra]):
                    best = min(best, cost + len(extra) * costs.insert)
            continue
        r = roles[k]
        if out:
            stack.append((k + 1, out, cost + (costs.merge if r in (0, out[-1]) else costs.merge_other)))
        for extra in fillers:
            for q in (1, 2, 3):
                label = 0 if q == r else costs.unknown if r == 0 else costs.relabel
                new = (*out, *extra, q)
                if all(b in chat.NEXT[a] for a, b in zip((0, *new[:-1]), new, strict=True)):
                    stack.append((k + 1, new, cost + label + len(extra) * costs.insert))
    return best


def test_repairs_cost_least_and_are_legal():
    automaton, costs = chat.Automaton(), chat.Costs()
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            total, steps = automaton.repair(list(roles))
            assert total == cheapest(list(roles), costs), roles
            out, spent = [], 0
            for state, action, added, cost in steps:
                spent += cost
                out += added
                if action == "merge":
                    assert out[-1] == state
                else:
                    out.append(state)
            extra, close = automaton.close[out[-1]]
            assert legal(out + list(close)) and spent + extra == total


TURNS = "conv_id long, turn long, role string, text string, n long, low string, cost string, chunk string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 0, "l", "c", "k") for r in rows], TURNS)


def random_turns(seed, conv, n):
    rng = random.Random(seed)
    return [(conv, k, rng.choice(["user", "assistant", "User ", "system", "tool", None]), rng.choice(["hi", "", None, "a <|user|> b"]) ) for k in range(n)]


def rendered(rows):
    return "".join(r.rendered for r in sorted(rows, key=lambda r: (r.chunk, r.place)))


def test_long_conversations_are_cut_without_a_trace(spark):
    rows = random_turns(1, 1, 400) + random_turns(2, 2, 50) + random_turns(3, None, 90) + [(4, None, "user", "late"), (4, 1, "user", "early")]
    rows += [(5, 7, "user", "same")] * 60 + [(6, None, "assistant", str(k)) for k in range(300)] + [(6, 3, "user", str(k)) for k in range(90)]
    rows += [(7, 10**12, "assistant", "far off")] + random_turns(4, 7, 200)
    whole, cut = (chat.repair(conversations(spark, rows), chunk_turns=n).collect() for n in (4096, 37))
    assert len(whole) == len(cut) == len(rows) and {r.chunk for r in whole} == {0} and len({r.chunk for r in cut}) > 3
    assert max(Counter((r.conv_id, r.chunk) for r in cut).values()) <= 37
    for conv in (1, 2, None, 4, 5, 6, 7):
        a, b = (sorted((r for r in x if r.conv_id == conv), key=lambda r: (r.chunk, r.place)) for x in (whole, cut))
        same = lambda r: (r.turn, r.role, r.role_out, r.action, r.inserted, r.cost, r.rendered)
        assert list(map(same, a)) == list(map(same, b))
        heads = [h.split("|>")[0] for h in rendered(b).split("<|")[1:]]
        turns = heads[::2]
        assert heads[1::2] == ["end"] * len(turns)
        assert legal([chat.ROLES.index(t) + 1 for t in turns])
    parts = chat.conversations(chat.repair(conversations(spark, rows), chunk_turns=37)).collect()
    for conv in (1, 2, None, 7):
        mine = sorted((p for p in parts if p.conv_id == conv), key=lambda p: p.part)
        assert "".join(p.rendered for p in mine) == rendered([r for r in whole if r.conv_id == conv])
        assert sum(p.cost for p in mine) == sum(r.cost for r in whole if r.conv_id == conv)


def test_rendering(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "yes"), (1, 3, "user", None)]
    got = chat.repair(conversations(spark, rows))
    text = chat.conversations(got).first()
    assert text.rendered == "<|user|>\nhi\n\nthere<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert text.cost == 3
    assert [r.inserted for r in got.orderBy("place").collect()] == ["", "", "", "|assistant"]


def test_no_conversations(spark):
    assert chat.repair(conversations(spark, [])).count() == 0
