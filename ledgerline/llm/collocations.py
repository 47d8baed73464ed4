"""Phrase collocations from vertical positional lists: every phrase's list of places, extended by the lists of the words next to them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .hashing import U, mix

#: Words of a block. A block's lists are held by one task; phrases never cross blocks, which end where pieces do.
BLOCK = 1 << 21
#: Bytes tokenized at once, but for longer pieces.
CHUNK = 1 << 20
#: Bits of a filter of frequent phrases (8 MB, whatever the corpus). Where bits coincide a phrase is extended in vain; counts stay exact.
BITS = 1 << 26
MARK = b"\xff"  # occurs in no UTF-8 text
#: A-Z to lower case, the ends of pieces to the mark.
TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Block:
    """The words of some texts of a language, by number in text order; 0 stands where a piece ends."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {MARK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words, numbers = text.replace(MARK, b" \xff ").split(), self.numbers
        self.parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(words) + 1

    def lists(self, block: int, lang: str) -> Iterator[pa.RecordBatch]:
        """One row a word: how often it occurs, and where (the first place, then steps)."""
        codes = np.concatenate(self.parts)
        order = np.argsort(codes, kind="stable").astype(np.int32)
        count = np.bincount(codes, minlength=len(self.numbers))
        end = np.cumsum(count)
        steps = np.diff(order, prepend=np.int32(0))
        begin = end - count
        steps[begin[1:][count[1:] > 0]] = order[begin[1:][count[1:] > 0]]
        words = list(self.numbers)
        for i in range(1, len(words), 16384):
            j = min(i + 16384, len(words))
            offsets = np.concatenate(([0], end[i:j] - begin[i])).astype(np.int32) * 4
            places = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(steps[begin[i] : end[j - 1]]))])
            texts = pa.array([w.decode("utf-8", "replace") for w in words[i:j]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, block)), pa.array([lang] * (j - i)), texts, pa.array(count[i:j]), places], names=["block", "lang", "word", "n", "places"])


def chunks(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end where pieces do."""
    while len(text) > size:
        cut = text.rfind(MARK, 0, size)
        cut = cut if cut >= 0 else text.find(MARK, size)
        if cut < 0:
            break
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


def word_lists(docs: DataFrame, lang_col: str, text_col: str, size: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(block, lang, word, n, places): the positional inverted lists of all words, a block's at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Block] = {}
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for i in range(len(b)):
                lang, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for part in chunks(text.encode("utf-8", "surrogatepass").translate(TABLE), chunk) if text else ():
                    block = open_.setdefault(lang, Block())
                    block.add(part)
                    if block.size >= size or sum(x.size for x in open_.values()) >= 2 * size:
                        full = max(open_, key=lambda x: open_[x].size)
                        yield from open_.pop(full).lists(number, full)
                        number += 1
        for lang, block in open_.items():
            yield from block.lists(number, lang)
            number += 1

    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "block long, lang string, word string, n long, places binary")


def phrase_hash(ids: Sequence[np.ndarray], bits: int) -> np.ndarray:
    out = np.full(len(ids[0]), len(ids), U)
    for x in ids:
        out = mix(out * U(0x9E3779B97F4A7C15) ^ x.view(U))
    return out & U(bits - 1)


def frequent_filter(phrases: DataFrame, k: int, bits: int) -> np.ndarray:
    """Bits set for the hashes of all phrases: made from partial words of bits, of which the driver gets bits / 64 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                h = np.unique(phrase_hash([b.column(i).to_numpy() for i in range(k)], bits))
                slot, first = np.unique(h >> U(6), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(np.bitwise_or.reduceat(U(1) << (h & U(63)), first).view(np.int64))], names=["slot", "bits"])

    words = np.zeros(bits // 64, U)
    found = phrases.select(*(f"w{i}" for i in range(k))).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    words[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(U)
    return words


def listed(words: np.ndarray, ids: Sequence[np.ndarray]) -> np.ndarray:
    h = phrase_hash(ids, 64 * len(words))
    return (words[(h >> U(6)).astype(np.int64)] >> (h & U(63))) & U(1) != 0


def extended(lists: DataFrame, filters: Sequence[np.ndarray]) -> DataFrame:
    """(lang, w0..wk-1, n): per block the length of each phrase's list, for phrases of one word more than there are filters.

    From words on, the list of a phrase's places is merge-joined with the places one further on of phrases of the same length; the
    phrases that both belong to a frequent one are the candidates of the next length.
    """
    k = len(filters) + 1

    def run(table: pa.Table) -> pa.Table:
        count = np.array([len(x) // 4 for x in (c.as_py() for c in table.column("places"))], np.int64)
        steps = np.frombuffer(b"".join(c.as_py() for c in table.column("places")), np.int32)
        # Steps back to places: a running sum, less what it was where each list began.
        total = np.cumsum(steps, dtype=np.int64)
        begin = np.cumsum(count) - count
        places = total - np.repeat(np.where(begin > 0, total[begin - 1], 0), count)
        by_place = np.argsort(places)
        places, of = places[by_place], np.repeat(np.arange(len(count)), count)[by_place]
        ids = table.column("id").to_numpy()
        # at: where phrases of the present length start, as indexes of places in order; of[at + i] is the i-th word.
        at = np.arange(len(places))
        for length, words in enumerate(filters, 1):
            at = at[listed(words, [ids[of[at + i]] for i in range(length)])]
            at = at[:-1][places[at[1:]] == places[at[:-1]] + 1] if len(at) else at
        group = np.zeros(len(at), np.int64)
        for i in range(k):  # number the phrases, a word at a time
            group = np.unique(group * len(ids) + of[at + i], return_inverse=True)[1]
        first = np.unique(group, return_index=True)[1]
        n = np.bincount(group, minlength=len(first))
        columns = [pa.array(ids[of[at[first] + i]]) for i in range(k)]
        lang = table.column("lang")[0].as_py()
        return pa.table([pa.array([lang] * len(first), pa.string()), *columns, pa.array(n.astype(np.int64))], names=["lang", *(f"w{i}" for i in range(k)), "n"])

    schema = ", ".join(["lang string", *(f"w{i} long" for i in range(k)), "n long"])
    return lists.groupBy("block").applyInArrow(run, schema)


def word_ids(words: DataFrame) -> Column:
    """A 64-bit id that tells all words of a language apart: the first seed for which no two share a hash."""
    seed = 0
    while not words.groupBy("lang", F.xxhash64(F.lit(seed), "word").alias("id")).count().filter("count > 1").isEmpty():
        seed += 1
    return F.xxhash64(F.lit(seed), "word")


def collocations(
    docs: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000, lang_col: str = "lang", text_col: str = "text", block: int = BLOCK, chunk: int = CHUNK, bits: int = BITS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to max_words words that occur at least ``least`` times.

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line ends; words are what blanks and tabs separate. n counts the language's words, a the phrase,
    l and r the two parts of the cut with the least score (of equal scores the first): score = floor(10^6 a a / (l r)).
    A phrase goes if a longer candidate holds it and occurs at least half as often. Ties in rank: larger a, then the phrase's bytes.

    Counting is exact at any size: phrases are told apart by word ids without collisions in this corpus (word_ids); the filters of frequent
    phrases only spare work. Null languages are ``und``; null and empty texts have no words; repeated rows count again; an empty table gives no rows.
    """
    lists = materialize(word_lists(docs, lang_col, text_col, block, chunk), "lists")
    words = materialize(lists.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    wid = word_ids(words)
    found = {1: words.select("lang", wid.alias("w0"), "f", "word")}
    postings = lists.select("block", "lang", wid.alias("id"), "places")
    filters = []
    for k in range(2, max_words + 1):
        filters.append(frequent_filter(found[k - 1].filter(F.col("f") >= least), k - 1, bits))
        keys = ["lang", *(f"w{i}" for i in range(k))]
        counts = extended(postings, filters).groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        found[k] = materialize(counts, f"phrases-{k}")
    release(lists)
    ranked = best_of([scored(found, k, max_words) for k in range(2, max_words + 1)], top)
    out = ranked.join(F.broadcast(materialize(totals, "totals")), "lang")  # one row a language
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def scored(found: dict[int, DataFrame], k: int, max_words: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of k words that no longer one stands for."""
    keys = [f"w{i}" for i in range(k)]
    df = found[k].withColumnRenamed("f", "a")
    for cut in range(1, k):
        for side, part in (("l", keys[:cut]), ("r", keys[cut:])):
            other = found[len(part)].select("lang", *(F.col(f"w{i}").alias(p) for i, p in enumerate(part)), F.col("f").alias(f"{side}{cut}"))
            df = df.join(other, ["lang", *part])
    for i, key in enumerate(keys):
        df = df.join(found[1].select("lang", F.col("w0").alias(key), F.col("word").alias(f"t{i}")), ["lang", key])
    if k < max_words:
        longer = None
        for m in range(k + 1, max_words + 1):
            for s in range(m - k + 1):
                part = found[m].select("lang", *(F.col(f"w{s + i}").alias(f"w{i}") for i in range(k)), F.col("f").alias("__f"))
                longer = part if longer is None else longer.union(part)
        df = df.join(longer.groupBy("lang", *keys).agg(F.max("__f").alias("__f")), ["lang", *keys], "left").filter("__f is null or 100 * __f < 50 * a")
    big = lambda c: f"cast({c} as decimal(15,0))"  # noqa: E731 - products have up to 37 digits; larger counts raise
    cuts = []
    for cut in range(1, k):
        whole = F.expr(f"(1000000 * ({big('a')} * {big('a')})) div ({big(f'l{cut}')} * {big(f'r{cut}')})")
        cuts.append(F.struct(whole.cast("long").alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
    best = F.array_min(F.array(*cuts)).alias("b")
    return df.select("lang", F.concat_ws(" ", *(f"t{i}" for i in range(k))).alias("phrase"), "a", best).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def best_of(parts: Sequence[DataFrame], top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` of each language, ranked: first within each of ``salts`` parts of it, then among what they leave."""
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "__salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def oracle(least: int = 10, top: int = 2000) -> str:
    """The same phrases of two and three words in DuckDB, counted in text order."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    score = lambda l, r: f"1000000 * cast(a as hugeint) * a // (cast({l} as hugeint) * {r})"
    return rf"""with pieces as (select lang, piece, row_number() over () as pid from (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) as piece from documents)),
        split as (select lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
        words as (select lang, pid, unnest(ws) as u, generate_subscripts(ws, 1) as i from split),
        grams as materialized (select lang, u, lead(u) over s as v, lead(u, 2) over s as w from words window s as (partition by pid order by i)),
        f1 as materialized (select lang, u, count(*) as f from grams group by all),
        f2 as materialized (select lang, u, v, count(*) as f from grams where v is not null group by all having count(*) >= {least}),
        f3 as materialized (select lang, u, v, w, count(*) as f from grams where w is not null group by all having count(*) >= {least}),
        longer as (select lang, u, v, max(f) as f from (select lang, u, v, f from f3 union all select lang, v, w, f from f3) group by all),
        two as (select p.lang, p.u || ' ' || p.v as phrase, p.f as a, x.f as l, y.f as r from f2 p join f1 x on x.lang = p.lang and x.u = p.u join f1 y on y.lang = p.lang and y.u = p.v
            left join longer g on g.lang = p.lang and g.u = p.u and g.v = p.v where g.f is null or 100 * g.f < 50 * p.f),
        three as (select p.lang, p.u || ' ' || p.v || ' ' || p.w as phrase, p.f as a, x.f as l1, xr.f as r1, yl.f as l2, y.f as r2 from f3 p
            join f1 x on x.lang = p.lang and x.u = p.u join f2 xr on xr.lang = p.lang and xr.u = p.v and xr.v = p.w
            join f2 yl on yl.lang = p.lang and yl.u = p.u and yl.v = p.v join f1 y on y.lang = p.lang and y.u = p.w),
        scored as (select lang, phrase, a, l, r, {score("l", "r")} as score from two union all
            select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2)
            from (select *, {score("l1", "r1")} as s1, {score("l2", "r2")} as s2 from three)),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored)
        select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
        from ranked join (select lang, sum(f) as n from f1 group by lang) using (lang) where rank <= {top}"""
