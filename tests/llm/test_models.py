"""Quality, toxicity, languages, neighbours and hosts: against brute force or held-out accuracy."""

import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import toxicity as tox
from ledgerline.llm.binomial import beta_cdf, upper_bound
from ledgerline.llm.language import declared, identify, visible
from ledgerline.llm.neighbours import search
from ledgerline.llm.quality import RULES, judge, text_stats
from ledgerline.llm.urls import judge_urls


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_texts():
    r = random.Random(1)
    texts = [None, "", " \n", "a b c d e f g h", "a b c d e f g h " * 2, "\u00a0x\u2003y", "z " * 40, "l1\nl1\n\nl2\x0bl1\n l1"]
    texts += ["".join(r.choice(["a ", "b ", "é", "\n", "#", "<", "\t", "c\n"]) for _ in range(r.randint(1, 300))) for _ in range(200)]
    assert [text_stats(t) for t in texts] == [brute_stats(t) for t in texts]


def test_exact_bounds():
    assert upper_bound(np.array([0]), np.array([20]), 0.05)[0] == pytest.approx(1 - 0.05 ** (1 / 20), abs=1e-9)
    for k, n in ((0, 10), (3, 17), (9, 10), (40, 900)):
        b = float(upper_bound(np.array([k]), np.array([n]), 0.01)[0])
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(b) + (n - i) * math.log1p(-b)) for i in range(k + 1))
        assert tail == pytest.approx(0.01, abs=1e-7)
    assert upper_bound(np.array([5, 0]), np.array([5, 0]), 0.05).tolist() == [1, 1]
    assert float(beta_cdf(2.0, 3.0, 0.4)) == pytest.approx(0.5248, abs=1e-6)


def test_rules_keep_good_documents(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    rows, labels = [], []
    for k in range(1600):
        bad = k % 5 == 0
        text = good()
        rows.append((k, text.replace(" ", "### ") if bad else text, None if k % 2 else "en"))
        labels.append((k, int(not bad)))
    rows += [(9000, None, "en"), (9001, "short", "xx"), (None, good(), "en"), (9002, "same words again and so on " * 9, "en")]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, lang string, n_words int").repartition(3)
    got = {(x.doc_id, x.kept, x.base_failed) for x in judge(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int"), alpha=0.05).collect()}
    kept = {d for d, k, _ in got if k}
    assert len(got) == len(rows) and not any(k % 5 == 0 and k in kept for k in range(1600))
    assert all(k in kept for k in range(1600) if k % 5) and None in kept
    assert {d for d, _, b in got if b} == {9000, 9001, 9002} and len(RULES) == 3
    few = judge(docs, spark.createDataFrame(labels[:10], "doc_id long, quality int"))
    assert few.filter("not kept and not base_failed").count() == 0
    assert judge(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def plain_bound(k, n, level):
    """Clopper-Pearson by bisection of the binomial tail, summed term by term."""
    if k >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(50):
        p = (lo + hi) / 2
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        lo, hi = (p, hi) if tail > level else (lo, p)
    return lo


def brute_kept(rows, good, alpha, delta, grid=64):
    """rows: (doc_id, text, stratum); good: ids to labels. Every cutoff of every rule and stratum, tried from the loosest on."""
    cuts = [0.0] + [1e-4 ** (1 - k / grid) for k in range(1, grid)]
    stats = {d: brute_stats(t) for d, t, _ in rows}
    failed = {d: s[0] < 20 or 100 * s[5] > 30 * s[0] for d, s in stats.items()}
    measures = [lambda s: s[2] / max(s[1], 1), lambda s: s[4] / max(s[3], 1), lambda s: s[5] / max(s[0], 1)]
    held = [(d, lang) for d, _, lang in rows if d in good and not failed[d]]
    strata = {lang for _, lang in held}
    chosen = {}
    for lang in strata:
        for m, measure in enumerate(measures):
            fine, bad = ([measure(stats[d]) for d, x in held if x == lang and good[d] == y] for y in (1, 0))
            best = (0, None)
            for c in reversed(cuts):
                if plain_bound(sum(x > c for x in fine), len(fine), delta / (3 * len(strata))) > alpha / 3:
                    break
                best = max(best, (sum(x > c for x in bad), c), key=lambda b: b[0])
            chosen[lang, m] = best[1]
    rejects = lambda d, lang: any(chosen.get((lang, m)) is not None and f(stats[d]) > chosen[lang, m] for m, f in enumerate(measures))
    return {d: not failed[d] and not rejects(d, lang) for d, _, lang in rows}, chosen


def test_kept_is_that_of_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, good = [], {}
    for d in range(1500):
        bad, lang = r.random() < 0.25, r.choice(["en", "en", "de", None])
        words = [word() + ("#" if r.random() < (0.2 if bad else 0.004) else "") for _ in range(r.randint(15, 70))]
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        lines += [r.choice(lines) for _ in range(r.choice([0, 1, 3]) if bad else r.random() < 0.03)]
        rows.append((d, "\n".join(lines), lang))
        if r.random() < 0.8:
            good[d] = int(not bad)
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, kept int").repartition(3)
    want, chosen = brute_kept(rows, good, 0.06, 0.05)
    got = {x.doc_id: x.kept for x in judge(docs, spark.createDataFrame(list(good.items()), "doc_id long, quality int"), alpha=0.06).collect()}
    assert got == want and sum(c is not None for c in chosen.values()) >= 2 and 0 < sum(want.values()) < len(want)


def toxic_corpus(n=1200, seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    out = []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randint(15, 120))]
        bad = k % 4 == 0
        if bad:
            for _ in range(max(1, len(text) // 20)):
                text.insert(r.randrange(len(text)), r.choice(["grubwort", "zoffkopf", "quarzelnde"]))
        out.append((k, " ".join(text), int(bad)))
    return out


def test_toxic_documents_are_told_apart(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, rows[0][1], "x")], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tox.toxicity(docs, labels).collect()}
    truth = {d: y for d, _, y in rows}
    held = [d for d in truth if got[d].held_out]
    assert 300 < len(held) < 500
    right = [got[d].predicted == truth[d] for d in held]
    assert np.mean(right) > 0.97
    assert got[5000].score == got[5001].score and got[5000].predicted == 0 and got[None].predicted == 1
    assert tox.toxicity(docs.limit(0), labels).collect() == []
    assert tox.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0


def test_held_out_recall_and_false_positives():
    """On the driver's own documents: at least the recall and at most the false positives that the README states."""
    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/sf0.1"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    rows = duckdb.sql(f"select doc_id, text, toxic from '{at}/documents.parquet' join '{at}/labels.parquet' using (doc_id) where toxic is not null and length(text) < 20000 order by doc_id").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    bad, good = [t for _, t, y in known if y], [t for _, t, y in known if not y]
    model = tox.train(bad, good[:3000], len(good) / len(bad))
    gains = tox.Gains(model.toxic, model.ordinary)
    says = np.array([np.array(tox.features(gains.of(tox.windows(t)))) @ model.weights >= np.log(0.7 / 0.3) for _, t, _ in held])
    truth = np.array([y == 1 for _, _, y in held])
    assert says[truth].mean() > 0.4 and says[~truth].mean() < 0.006


def test_held_out_recall_on_a_larger_corpus():
    """The pipeline drops by the score's cut alone: it took 0.73 of these before, with 0.15 % of the others."""
    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/check_s"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    tables = [f"{at}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{at}/{t}.parquet") else "") for t in ("documents", "labels")]
    rows = duckdb.sql(f"select doc_id, text, toxic from '{tables[0]}' join '{tables[1]}' using (doc_id) where toxic is not null and length(text) < 20000 order by md5(doc_id::varchar)").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1][:1500]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    bad, good = [t for _, t, y in known if y], [t for _, t, y in known if not y]
    model = tox.train(bad[:3000], good[:3000], len(good) / len(bad))
    gains = tox.Gains(model.toxic, model.ordinary)
    says = np.array([np.array(tox.features(gains.of(tox.windows(t)))) @ model.weights >= np.log(0.7 / 0.3) for _, t, _ in held])
    truth = np.array([y == 1 for _, _, y in held])
    print("recall", says[truth].mean(), "false positives", says[~truth].mean())
    assert says[truth].mean() > 0.77 and says[~truth].mean() < 0.01


def test_dictionaries_hold_text_alone():
    r = random.Random(2)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    samples = [" ".join(r.choice(words) for _ in range(12)).encode() for _ in range(2000)]
    assert set(tox.trained(samples, 4096, 16)) <= set(b"aeinrst ")


def test_windows_hold_the_whole_text():
    r = random.Random(2)
    for text in (None, "", " \n", "a", "Ä" * 5000, "x" * 100_000, " ".join("w" * r.randint(1, 90) for _ in range(3000))):
        pieces = tox.windows(text)
        assert b"".join(b"".join(p.split()) for p in pieces) == b"".join((text or "").lower().encode().split())
        assert all(len(p) <= 6 * tox.WINDOW for p in pieces)


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((900, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 15), (2004, [None] + [1.0] * 15), (None, rows[0][1]), rows[5]]
    df = spark.createDataFrame([(*a, 1) for a in rows + odd], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = search(df, k=20, every=20, mass=0.5).collect()
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append(g)
    assert set(by) == set(range(0, 900, 20)) and all(sorted(g.rank for g in v) == list(range(1, 21)) for v in by.values())
    y, hits = x.astype(float), 0
    for q, v in by.items():
        s = y @ y[q]
        want = sorted((k for k in range(900) if k != q), key=lambda k: (-s[k], k))[:20]
        hits += len({g.vec_id for g in v} & set(want))
        assert [g.vec_id for g in sorted(v, key=lambda g: g.rank)] == [g.vec_id for g in sorted(v, key=lambda g: (-g.score, g.vec_id))]
        assert all(g.score == pytest.approx(s[g.vec_id], abs=1e-12) for g in v)
    assert hits / (20 * len(by)) > 0.9
    assert [g.vec_id for g in sorted(by[100], key=lambda g: g.rank)][:20] == list(range(101, 121))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert search(few, k=20).count() == 2 and search(few.limit(0)).collect() == []


def test_url_rules_and_reputations(spark):
    urls = ["http://a.Example.COM/en/7x?q", "http://x.com/en/1", "HTTP://s.net/de/1", "ftp://b.example.net/de/8#x", "http://org/es/", "http://xorg/es/", "no scheme", None, "x://h?y/z", "http://bad.co.uk/1"]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)] + [(100 + k, f"http://bad.co.uk/{k}", "r") for k in range(60)] + [(200 + k, f"http://good.net/{k}", "r") for k in range(200)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(100 + k, 0) for k in range(60)] + [(200 + k, 1) for k in range(200)] + [(None, 0), (0, None)], "doc_id long, quality int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1] == ("x.com", "/en/1", "com/en/", "block")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[5][2] is None and got[6][:2] == ("", "") and got[7][:2] == ("", "") and got[8][:2] == ("h", "")
    assert got[9][3] == "block" and got[250][3] == "allow" and got[110][3] == "block"
    assert judge_urls(pages.limit(0), labels).collect() == [] and judge_urls(pages, labels.limit(0)).count() == 270


def test_a_host_is_judged_against_the_others(spark):
    """Posteriors in plain Python, each level's prior without the host's own outcomes."""
    from ledgerline.llm.urls import reputations, strength

    r = random.Random(9)
    hosts = {f"h{i}.d{i % 4}.{'com' if i % 3 else 'co.uk'}": (r.randint(0, 12), r.random()) for i in range(24)} | {"alone.org": (5, 0.9), "": (2, 0.5)}
    outcomes = [(h, int(r.random() < p)) for h, (n, p) in hosts.items() for _ in range(n)]
    part = lambda h: (".".join(h.split(".")[1:]) if h.startswith("h") else h, "co.uk" if h.endswith("co.uk") else h.rsplit(".", 1)[-1])
    seen, known = spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame(outcomes, "host string, bad long")
    count = lambda f: {v: (sum(f(h) == v for h, _ in outcomes), sum(b for h, b in outcomes if f(h) == v)) for v in {f(h) for h, _ in outcomes}}
    levels = [count(f) for f in (lambda h: part(h)[1], lambda h: part(h)[0], lambda h: h)]
    prior = [strength(spark.createDataFrame(list(x.values()), "n long, k long")).first() for x in levels]
    got = {x.host: x.bad_bound for x in reputations(seen, known).collect()}
    assert set(got) == set(hosts)
    for h in hosts:
        n, k = levels[2].get(h, (0, 0))
        mean = prior[0]["mean"]
        for level, at, (kappa, _) in zip(levels[:2], (part(h)[1], part(h)[0]), prior[:2]):
            m, j = level.get(at, (0, 0))
            mean = (j - k + kappa * mean) / (m - n + kappa)
        a, s = k + prior[2].kappa * mean, n + prior[2].kappa
        assert got[h] == pytest.approx(a / s - 1.645 * math.sqrt(a * (s - a) / (s * s * (s + 1))), abs=1e-9)


def test_languages_fuse_evidence(spark):
    r = random.Random(6)
    kinds = {"aa": "abcde", "bb": "vwxyz"}
    text = lambda lang, n: " ".join("".join(r.choice(kinds[lang]) for _ in range(4)) for _ in range(n))
    docs = spark.createDataFrame([(k, text(lang, 50), lang) for k in range(20) for lang in kinds] + [(99, None, None)], "doc_id long, text string, lang string")
    page = lambda lang, body: f'<html lang="{lang}"><script>{text("bb", 30)}</script><p>{body}</p>'
    rows = [(k, f"http://h{k % 3}.aa.com/", page("aa", text("aa", 30))) for k in range(30)] + [(100 + k, "http://w.bb.org/", page("bb", text("bb", 30))) for k in range(30)]
    rows += [(500, "http://w.bb.org/x", "<html><p></p>"), (501, "http://h1.aa.com/", None), (502, None, page("aa", "")), (503, "http://w.bb.org/", page("aa", text("bb", 40)))]
    got = {x.page_id: x for x in identify(spark.createDataFrame([(*a, "z") for a in rows], "page_id long, url string, html string, lang string"), docs).collect()}
    assert all(got[k].lang == "aa" for k in range(30)) and all(got[100 + k].lang == "bb" for k in range(30))
    assert got[500].lang == "bb" and got[501].lang == "aa" and got[502].lang == "aa" and got[503].lang == "bb" and got[500].text_lang is None
    pages = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    assert identify(pages, docs.limit(0)).first().lang is None and identify(pages.limit(0), docs).collect() == []


def test_every_language_is_modelled(spark):
    r = random.Random(8)
    letters = [chr(0x4E00 + 40 * k) for k in range(90)]
    text = lambda k, n: " ".join("".join(chr(ord(letters[k]) + r.randrange(6)) for _ in range(4)) for _ in range(n))
    docs = spark.createDataFrame([(text(k, 40), f"l{k:02d}") for k in range(90) for _ in range(1 + (k < 64))] + [(None, "none")], "text string, lang string")
    pages = [(k, f"http://h{k % 7}.com/", f"<p>{text(k % 90, 30)}</p>") for k in range(180)]
    got = identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()
    assert {x.page_id: (x.text_lang, x.lang) for x in got} == {k: (f"l{k % 90:02d}",) * 2 for k in range(180)}


def test_visible_text_takes_linear_time():
    assert visible('a<!-- <b> -->b<SCRIPT x="1">var c;</Script >d<p title="x">e</p>f<style>g') == "a b d e f g"
    assert visible(None) == "" and visible("1 < 2") == "1 < 2" and visible("x<!-->y") == "x y"
    assert declared('<HTML x>..<html dir=ltr lang = "DE-at">') == "de" and declared("<p>") == "" and declared(None) is None and declared("<html><p lang=fr>") == ""
    for piece in ("<!--", "<script>", "<html ", "<html>", "<", "</script", "<style></script>", " lang "):
        began = time.perf_counter()
        visible(piece * (1 << 20))
        declared(piece * (1 << 18))
        assert time.perf_counter() - began < 10


def test_a_declaration_never_seen_counts_less_than_one_seen_once(spark):
    """10,000 pages for each of two languages; one page of bb declares zz, none of aa does."""
    r = random.Random(3)
    kinds = {"aa": "abcde", "bb": "vwxyz"}
    text = lambda lang, n: " ".join("".join(r.choice(kinds[lang]) for _ in range(4)) for _ in range(n))
    docs = spark.createDataFrame([(text(lang, 50), lang) for _ in range(20) for lang in kinds], "text string, lang string")
    rows = [(k, f"http://h{k}.com/", f"<html lang={lang}><p>{text(lang, 4)}") for k, lang in enumerate(["aa", "bb"] * 10_000)]
    rows += [(50_000, "http://x.com/", f"<html lang=zz><p>{text('bb', 9)}"), (50_001, "http://y.com/", "<html lang=zz>")]
    rows += [(60_000 + k, "http://one.org/", f"<html lang=aa><p>{text('aa', 6)}") for k in range(2)] + [(60_010, "http://alone.net/", f"<html><p>{text('aa', 6)}")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x for x in identify(pages, docs).filter("page_id >= 50000").collect()}
    assert got[50_001].lang == "bb" and got[50_001].posterior > 0.6
    assert got[60_010].lang == "aa" and got[60_000].lang == "aa"


def brute_identify(pages, likely, langs, per_gram=0.25, kappas=(50.0, 20.0, 10.0)):
    """pages: (suffix, domain, host, declared), likely: each page's log-likelihoods or none."""
    n, looks = len(langs), [None if x is None else int(np.argmax(x)) for x in likely]
    values = len({p[3] for p, t in zip(pages, looks) if t is not None}) + 1
    out = []
    for i, p in enumerate(pages):
        prior = np.full(n, 1.0 / n)
        for level, kappa in zip(range(4), (n, *kappas)):
            c = np.zeros(n)
            for j, q in enumerate(pages):
                if j != i and looks[j] is not None and q[:level] == p[:level]:
                    c[looks[j]] += 1
            prior = (c + kappa * prior) / (c.sum() + kappa)
        said, all_ = np.zeros(n), np.zeros(n)
        for j, q in enumerate(pages):
            if j != i and looks[j] is not None:
                all_[looks[j]] += 1
                said[looks[j]] += q[3] == p[3]
        logs = (0 if likely[i] is None else per_gram * np.array(likely[i])) + np.log(prior) + np.log((said + 0.5) / (all_ + 0.5 * values))
        e = np.exp(logs - logs.max())
        out.append((langs[int(e.argmax())], 1 / e.sum()))
    return out


def test_posteriors_are_those_of_brute_force(spark):
    r = random.Random(12)
    kinds = {"aa": "abcdef", "bb": "defghi", "cc": "ghijkl"}
    text = lambda lang, n: " ".join("".join(r.choice(kinds[lang]) for _ in range(3)) for _ in range(n))
    docs = spark.createDataFrame([(text(lang, 60), lang) for _ in range(10) for lang in kinds], "text string, lang string")
    hosts = [("com", "a.com", "x.a.com"), ("com", "a.com", "y.a.com"), ("com", "b.com", "b.com"), ("co.uk", "c.co.uk", "c.co.uk"), ("org", "d.org", "w.d.org")]
    rows, known = [], []
    for k in range(60):
        at, lang, says = r.choice(hosts), r.choice(list(kinds)), r.choice(["aa", "bb", "cc", "xx", ""])
        body = text(lang, r.choice([0, 1, 2, 12]))
        rows.append((k, f"http://{at[2]}/{k}", f'<html{" lang=" + says if says else ""}><p>{body}'))
        known.append((*at, says))
    from ledgerline.llm.language import text_model, trigrams

    model = text_model(docs)
    grams = [trigrams(visible(h)) for _, _, h in rows]
    want = brute_identify(known, [model.likely(g) if len(g) else None for g in grams], model.names)
    got = {x.page_id: x for x in identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    for k, (lang, p) in enumerate(want):
        assert got[k].posterior == pytest.approx(p, abs=1e-8) and (got[k].lang == lang or p < 0.5 + 1e-9)


def test_neighbours_at_the_registered_parameters(spark):
    """Several blocks; isotropic vectors, where an index can help least."""
    r = np.random.default_rng(8)
    x = r.standard_normal((5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for g in search(df).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    y = x.astype(np.float32).astype(float)
    hits = sum(len(got[q] & {k for k in sorted((k for k in range(5000) if k != q), key=lambda k: (-s[k], k))[:20]}) for q in range(0, 5000, 20) for s in [y @ y[q]])
    assert hits / (20 * 250) >= 0.9 and all(len(v) == 20 for v in got.values())
