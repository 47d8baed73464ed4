"""Collocations against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import collocations as c


def brute(rows, max_words, least, top):
    out = []
    langs = {}
    for text, lang in rows:
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            langs.setdefault(lang or "und" if lang is None else lang, []).append(re.findall(r"[^\x20\x09]+", piece))
    for lang, pieces in langs.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, max_words + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        cands = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        held = Counter()
        for g, a in cands.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    held[g[i : i + k]] = max(held[g[i : i + k]], a)
        scored = []
        for g, a in cands.items():
            if 100 * held[g] >= 50 * a and held[g]:
                continue
            s, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-s, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus(seed, n=400):
    r = random.Random(seed)
    words = ["the", "The", "of", "élan", "a-b", "new", "york", " ", "x\x00", "\x1c", "zz", "Ünder"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice([*words, "new york city"]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for _ in range(r.randint(0, 30)))
        rows.append((r.choice([text, text, text, None]), r.choice(["en", "en", "en", "de", None, ""])))
    return rows + rows[:20] + [("new york " * 4000, "en"), ("one " * 9, "fr"), ("two two " * 5 + "three", "fr"), ("", "en")]


@pytest.mark.parametrize(("max_words", "least", "top"), [(3, 10, 2000), (2, 3, 5), (4, 4, 50)])
def test_equals_counting(spark, max_words, least, top):
    sizes = {} if max_words == 3 else {"block": 700, "chunk": 64}
    rows = corpus(max_words)
    df = spark.createDataFrame([(i, *x, 1, "w0") for i, x in enumerate(rows)], "doc_id long, text string, lang string, n int, word string").repartition(3)
    got = c.collocations(df, max_words, least, top, **sizes).collect()
    assert sorted(map(tuple, got)) == brute(rows, max_words, least, top)


def test_filters_spare_work_only(spark):
    """With 64 bits nearly every phrase passes the filters; the result is the same."""
    rows = corpus(9)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, c.collocations(df, 3, 10, 2000, bits=64).collect())) == brute(rows, 3, 10, 2000)


def test_empty_tables_and_texts(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert c.collocations(empty).collect() == []
    assert c.collocations(spark.createDataFrame([(None, "en"), ("", None), (" \t.", "de")], "text string, lang string")).collect() == []


def test_lists_hold_every_place(spark):
    rows = c.word_lists(spark.createDataFrame([("B a b. a", "en"), ("a", "en")], "text string, lang string").coalesce(1), "lang", "text").collect()
    places = {r.word: np.cumsum(np.frombuffer(r.places, np.int32)).tolist() for r in rows}
    assert places == {"b": [0, 2], "a": [1, 4, 6]} and {r.word: r.n for r in rows} == {"b": 2, "a": 3}


def test_long_texts_are_cut_where_pieces_end():
    text = b"aaaa bbbb cccc\xffd\xffe f\xffggggggggggggggg"
    parts = list(c.chunks(text, 8))
    assert b"\xff".join(parts) == text and max(map(len, parts)) <= 15


def test_scores_pass_64_bits(spark):
    words = spark.createDataFrame([("en", i, 10**14, w) for i, w in enumerate("ab")], "lang string, w0 long, f long, word string")
    pair = spark.createDataFrame([("en", 0, 1, 10**14 - 1)], "lang string, w0 long, w1 long, f long")
    got = c.scored({1: words, 2: pair}, 2, 2).collect()[0]
    assert got.score == 10**6 * (10**14 - 1) ** 2 // 10**28 and got.phrase == "a b"
