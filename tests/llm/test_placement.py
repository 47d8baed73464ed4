"""Sharding, mixing and packing: whole results, laws and ties."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from ledgerline.llm.mixing import edf, exact, mix, quotas, schedule
from ledgerline.llm.packing import Words, balanced, pack
from ledgerline.llm.sharding import shard

PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = [(k, r.choice([None, "", "ä" * r.randint(1, 9), "x " * r.randint(1, 400)]), r.choice(["a"] * 6 + ["b", "c", None])) for k in range(n)]
    rows += [(None, "none", "a"), (7, "again", "b"), (7, "again", "b")]
    return rows, spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, source string, size string").repartition(3)


def test_shards_are_contiguous_balanced_and_whole(spark):
    rows, df = docs(spark)
    got = sorted(shard(df, 40).collect(), key=lambda r: (r.shard, r.slot))
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1]))
    assert [(r.doc_id, r["size"], r.text_crc32) for r in got] == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all([r.slot for r in rs] == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(40))
    total = sum(r["size"] for r in got)
    largest = max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in by[k]) - total / 40) <= largest for k in range(40))
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    assert shard(df.limit(0)).collect() == []


def test_schedule_keeps_every_deadline():
    for weights in ({"a": 1, "b": 1}, {"a": 0.6, "b": 0.3, "c": 0.07, None: 0.03}, {"a": 1}):
        quota = quotas(weights, 100)
        assert sum(quota.values()) == 100
        plan, done = schedule(quota), Counter()
        assert [s for _, _, s, _, _ in plan] == list(range(100))
        for source, j, slot, release, due in plan:
            assert release <= slot < due and j == done[source]
            done[source] += 1
            assert all(abs(done[s] - (slot + 1) * a / 100) < 1 for s, a in quota.items())


def test_mix_is_whole_and_follows_the_schedule(spark):
    rows, df = docs(spark)
    got = sorted(mix(df, block_docs=4, period=50).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, _, s in rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    for s in {r.source for r in got}:
        ids = [r.doc_id for r in got if r.source == s]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    equal = sorted(mix(df, {"a": 1, "b": 1, "c": 1, None: 1}, block_docs=1, period=4).collect(), key=lambda r: r.position)
    assert [len({r.source for r in equal[k : k + 4]}) for k in range(0, 80, 4)] == [4] * 20
    with pytest.raises(ValueError):
        mix(df, {"a": 1})
    assert mix(df.limit(0)).collect() == []


def test_balanced_pieces_fill_sequences():
    r = random.Random(2)
    for lengths in ([], [1], [8, 8], [20, 3], [r.randint(1, 40) for _ in range(60)]):
        pieces = balanced(lengths, capacity=8)
        held, seqs = defaultdict(list), defaultdict(list)
        for d, at, n, seq, offset in pieces:
            held[d].append((at, n))
            seqs[seq].append((offset, n))
        for d, n in enumerate(lengths):
            at = 0
            for start, size in sorted(held[d]):
                assert start == at
                at += size
            assert at == n
        for parts in seqs.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 8
        assert len(seqs) == -(-sum(lengths) // 8)


def test_words_are_the_tokenizers():
    words, r = Words(PATH, size=50), random.Random(3)
    alphabet = "abc ABC.,'’!12ÄäßİıΣσ́漢🙂\n\t\x1c <|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["don't <|endoftext|> x", "ŉa ǅ ﬁ"]
    for k in range(0, len(texts), 37):
        for text, ids in zip(texts[k : k + 37], words.ids(texts[k : k + 37])):
            assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_is_whole(spark):
    rows, df = docs(spark)
    words = Words(PATH)
    got = pack(df, PATH, capacity=64).collect()
    ids = Counter()
    for d, t, _ in rows:
        raw = words.ids([t or ""])[0] + (2).to_bytes(4, "little")
        ids[d, len(raw) // 4, raw] += 1
    tokens = defaultdict(list)
    for r in got:
        tokens[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 64 and [o for o, _ in sorted(x)] == np.cumsum([0, *[n for _, n in sorted(x)]])[:-1].tolist() for x in tokens.values())
    assert sum(r.length for r in got) == sum(n * c for (_, n, _), c in ids.items())
    raws = defaultdict(set)
    for d, _, raw in ids:
        raws[d].add(raw)
    assert all(any(zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for raw in raws[r.doc_id]) for r in got)
    assert pack(df.limit(0), PATH).collect() == []


def test_every_source_is_less_than_a_block_from_its_weight():
    for weights in ({"hot": 0.5} | {f"s{k:02d}": 0.5 / 19 for k in range(19)}, {"hot": 0.3} | {f"s{k:04d}": 0.7 / 1500 for k in range(1500)}):
        quota = exact(weights)
        names, done, end = list(quota), Counter(), 5000
        for slot, (n, j, at, release, due) in zip(range(end), edf(list(quota.values()), [end] * len(names))):
            assert at == slot and release <= slot < due and j == done[n]
            done[n] += 1
            if slot % 97 == 0:
                assert all(abs(done[k] - (slot + 1) * weights[s]) < 1 + 1e-9 for k, s in enumerate(names))
    assert quotas({"a": 1, "b": 1e-9}, 10) == {"a": 9, "b": 1} and exact({"a": 0.5, "b": 3}) == {"a": 1, "b": 6}


def test_mix_follows_the_weights_of_many_sources(spark):
    rows = [(k, "hot") for k in range(700)] + [(1000 + k, f"s{k % 1100:04d}") for k in range(2200)]
    weights = {"hot": 0.3} | {f"s{k:04d}": 0.7 / 1100 for k in range(1100)}
    got = sorted(mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=1).collect(), key=lambda r: r.position)
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    hot = 0
    for k, r in enumerate(got[:2000], 1):
        hot += r.source == "hot"
        assert r.slot == k - 1 and abs(hot - 0.3 * k) < 1 + 1e-9


def test_a_tokenizer_gives_back_what_its_making_took(monkeypatch):
    import public_tokenizers

    from ledgerline.llm import packing

    calls = []
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1))
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.words_of(path, 17) is packing.words_of(path, 17) and calls == [1]
