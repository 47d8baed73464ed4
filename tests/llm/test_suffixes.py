"""Repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

import ledgerline.llm.suffixes as suffixes
from ledgerline.llm.suffixes import Suffixes, removals


def brute(docs, length=100):
    """docs: (doc_id, text), ids distinct."""
    seen, out = set(), []
    for d, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé f") for _ in range(n))
    passages = [text(r.randint(80, 260)) for _ in range(6)]
    docs = [text(r.choice([0, 50, 99, 100, 400])) + r.choice(passages) + text(r.choice([0, 1, 300])) + r.choice(passages)[r.randint(0, 30) :] for _ in range(40)]
    docs += ["ab" * 300, "x" + "ab" * 120, "z" * 450, "z" * 99, None, "", docs[0], docs[3] + docs[4], "Nd, " * 60 + "ing " * 50, "y" + "Nd, " * 50]
    return [(k * 7 % 101, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize(("bucket", "context_bits"), [(200_000, 64), (40, 64), (200_000, 3), (40, 1)])
def test_removals_are_those_of_brute_force(spark, bucket, context_bits):
    """Also where contexts of other bytes have equal hashes, as few bits make them."""
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int").repartition(3)
    got = sorted(tuple(r) for r in removals(df, bucket=bucket, context_bits=context_bits).drop("kept").collect())
    assert got == brute(docs)


def twins():
    """Two texts without a common 100-byte string that hashes linear in the bytes, modulo a power of two, take for equal."""
    r = random.Random(11)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    data = np.frombuffer(letters.encode(), np.uint8)
    at = int(suffixes.grams(suffixes.prefix_hashes(data)).argmin())
    block = letters[at : at + suffixes.GRAM] + "qwerty"
    marks = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join(block + "xy"[m] for m in marks), "".join(block + "yx"[m] for m in marks)


@pytest.mark.parametrize("bucket", [200_000, 40])
def test_texts_of_equal_linear_hashes_stay(spark, bucket):
    docs = list(enumerate(twins(), 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in removals(df, bucket=bucket).drop("kept").collect())
    assert got == brute(docs)


def test_context_hashes_know_every_byte():
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 30_000).astype(np.uint8)
    data[10_000:20_000] = data[:10_000]
    start, size = r.integers(0, 5000, 300), r.integers(1, 5000, 300)
    a = suffixes.context_hashes(data, start, size)
    assert (a == suffixes.context_hashes(data, start + 10_000, size)).all() and len(set(a.tolist())) == len(set(zip(start.tolist(), size.tolist())))
    changed = data.copy()
    changed[7000] ^= 1
    held = (start <= 7000) & (start + size > 7000)
    assert ((suffixes.context_hashes(changed, start, size) != a) == held).all()


def test_a_long_text_and_a_copy_of_a_part(spark):
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh ") for _ in range(1_000_000))
    docs = [(1, text), (2, "new " + text[300_000:900_000] + " end"), (3, "a" * 300_000)]
    got = sorted(tuple(x) for x in removals(spark.createDataFrame(docs, "doc_id long, text string")).drop("kept").collect())
    assert got == brute(docs)


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    r = random.Random(5)
    a = "".join(r.choice("abcdef") for _ in range(150))
    df = spark.createDataFrame([(1, a), (1, a), (None, a), (2, "short"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed) for r in removals(df).collect()))
    assert got == [(0, 0, 0), (0, 150, 150), (1, 150, 0), (1, 150, 0), (2, 5, 0)]
    assert removals(df.limit(0)).collect() == []


def test_merge_sort_orders_suffixes():
    r = np.random.default_rng(0)
    data = np.concatenate([r.integers(0, 2, 400), np.tile([0, 1, 1], 60), np.zeros(60, int)]).astype(np.uint8)
    starts = r.permutation(len(data) - 20)
    classes = np.sort(r.integers(0, 4, len(starts)))
    order = Suffixes(data, 20).sort(starts, classes)
    key = [(classes[k], data[starts[k] : starts[k] + 20].tobytes()) for k in range(len(starts))]
    assert order.tolist() == sorted(range(len(starts)), key=lambda k: key[k])
