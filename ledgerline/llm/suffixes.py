"""Removal of repeated strings by a hash-compared suffix sort."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, tidy
from .hashing import BASE, INVERSE, LANE, U, mix, powers, prefix_hashes, span_hash

GRAM = 32
RUN = "anchor long, context long, doc long, at long, n int, places int"
#: Suffixes sorted at once, and bytes of their contexts; an anchor with more than BUCKET gets several buckets.
BATCH, BATCH_BYTES = 100_000, 2_000_000
BUCKET = 200_000


def slide(a: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """f over all windows of ``width``, by doubling."""
    have = 1
    while 2 * have <= width:
        a, have = f(a[:-have], a[have:]), 2 * have
    rest = width - have
    return f(a[:-rest], a[rest:]) if rest else a


def grams(h: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    n = len(h) - GRAM
    return mix((h[GRAM:] - h[:-GRAM]) * powers(INVERSE, n)[:n])


#: Longer contexts, as in periodic text, are hashed one by one.
LONG = 4096


def context_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each data[start : start + size], eight bytes at a time through the mixer: not linear in them, unlike prefix hashes."""
    lanes = np.ndarray((len(data),), "<u8", data.tobytes() + bytes(8), strides=(1,))
    h = mix(size.astype(U) * U(BASE))
    left, at = np.flatnonzero(size <= LONG), 0
    while len(left):
        h[left] = mix(h[left] ^ mix((lanes[start[left] + at] & LANE[np.minimum(size[left] - at, 8)]) + U(0x9E3779B97F4A7C15)))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest())
    return h


def anchor_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, start, n, places) for all windows of ``length`` bytes, n windows from start at a time.

    A window's anchor is the least hash of the GRAM-byte strings in it, so equal windows have equal anchors.
    Neighbouring windows of the same anchor are one run; its context is all their bytes. places is 2
    where the anchor comes again within the run, as in periodic text: only then can its own windows be equal.
    """
    h, span = prefix_hashes(data), length - GRAM + 1
    g = grams(h)
    least = slide(g, span, np.minimum)
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    end = np.append(start[1:], len(least))
    n = end - start
    place = np.concatenate([part + g[part[:, None] + np.arange(span)].argmin(axis=1) for part in np.split(start, range(2048, len(start), 2048))])
    places = np.where(end - 1 > place, 2, 1)
    return least[start], start, n, places


class Suffixes:
    """Suffixes of one buffer, compared over ``length`` bytes by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.data, self.length = data, length
        self.h, self.inverse = prefix_hashes(data), powers(INVERSE, len(data) + 1)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
        self.word = np.zeros(len(data) + 1, U)  # eight bytes from each place, the first one highest
        for k in range(8):
            self.word |= padded[k : k + len(data) + 1] << U(56 - 8 * k)

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Equal hashes of the first n bytes."""
        return (self.h[x + n] - self.h[x]) * self.inverse[x] == (self.h[y + n] - self.h[y]) * self.inverse[y]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, up to ``length``, by binary search over hashes."""
        out = np.full(len(x), self.length)
        left = np.flatnonzero(~self.same(x, y, self.length))
        x, y = x[left], y[left]
        h, hx, hy, ix, iy = self.h, self.h[x], self.h[y], self.inverse[x], self.inverse[y]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length - 1)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (h[x + mid] - hx) * ix == (h[y + mid] - hy) * iy
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[left] = low
        return out

    def less(self, x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Suffix x before y; ``equal`` says what counts where they agree. Most differ in their first eight bytes, or nowhere."""
        a, b = self.word[x], self.word[y]
        out = a < b
        more = np.flatnonzero(a == b)
        if len(more):
            x, y = x[more], y[more]
            n = self.common(x, y)
            last = np.minimum(n, self.length - 1)
            out[more] = np.where(n == self.length, equal[more], self.data[x + last] < self.data[y + last])
        return out

    def sort(self, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """A stable merge sort of the suffixes within each class (classes ascending): the order, as indexes.

        Bottom-up; on each level all runs of all classes are merged at once, each
        suffix finding its place in the neighbouring run by binary search.
        """
        n = len(starts)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
        count = np.diff(np.append(first, n))
        base, size = np.repeat(first, count), np.repeat(count, count)
        width = 1
        while True:
            act = np.flatnonzero(size > width)
            if not len(act):
                return order
            i = act - base[act]
            block = i // width
            lo = (block ^ 1) * width
            hi = np.minimum(lo + width, size[act])
            alone = lo >= size[act]  # no neighbour: stays
            lo, hi = np.where(alone, 0, lo), np.where(alone, 0, hi)
            right, begin = block % 2 == 1, lo.copy()
            mine, b = starts[order[act]], base[act]
            while True:  # count of the neighbour's suffixes that come before: from the left run also equal ones
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                other = starts[order[b[open_] + mid]]
                before = self.less(other, mine[open_], right[open_])
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            to = b + np.where(alone, i, np.where(right, block - 1, block) * width + (i - block * width) + (lo - begin))
            new = order.copy()
            new[to] = order[act]
            order, width = new, 2 * width

    def repeats(self, order: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Suffixes equal over ``length`` bytes to the one sorted before them, every byte compared."""
        x, y = starts[order[:-1]], starts[order[1:]]
        same = np.flatnonzero(classes[order[:-1]] == classes[order[1:]])
        same = same[self.same(x[same], y[same], self.length)]
        x, y, w = x[same], y[same], self.word
        equal = np.ones(len(same), bool)
        for k in (*range(0, self.length - 7, 8), self.length - 8) if self.length >= 8 else ():
            equal &= w[x + k] == w[y + k]
        for k in range(self.length) if self.length < 8 else ():
            equal &= self.data[x + k] == self.data[y + k]
        return order[1:][same[equal]]


def repeated_windows(anchors: np.ndarray, group: np.ndarray, contexts: Sequence[bytes], doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Suffixes]:
    """All windows of the contexts: (context, place in it, start in the buffer, repeats an earlier one of its group)."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    begin = np.cumsum(size) - size
    s = Suffixes(data, length)
    n = size - length + 1
    of = np.repeat(np.arange(len(contexts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = begin[of] + place
    # Equal windows have their anchor at the same distance: that splits groups into small classes.
    g = grams(s.h)
    marks = np.flatnonzero(g == np.repeat(anchors, size)[: len(g)])
    rel = marks[np.searchsorted(marks, start)] - start
    classes = group[of] * (length + 1) + rel
    first = np.argsort(classes, kind="stable")  # contexts come in the order of documents and places
    order = s.sort(start[first], classes[first])
    again = np.zeros(len(of), bool)
    again[first[s.repeats(order, start[first], classes[first])]] = True
    return of, place, start, again, s


def spans_of(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows: (doc, first, n)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)))) if len(doc) else np.empty(0, np.int64)
    return doc[cut], at[cut], np.diff(np.append(cut, len(doc)))


def arrays(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U else c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


def repeated_spans(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), bucket: int = BUCKET, context_bits: int = 64
) -> DataFrame:
    """The columns ``keep``, __id, __text and __spans for every row: spans are [start, bytes) of the text's UTF-8 that earlier strings cover.

    A byte is covered if a ``length``-byte string over it also starts earlier: in a document of smaller id, or earlier in its own.

    1. Runs of windows with a common anchor (see anchor_runs) are cut from all texts. Runs whose anchor occurs
       once hold nothing repeated. Of runs with equal context hash all but the first are taken for copies of it: neighbouring ones are
       joined to long spans, and a span is covered if its bytes equal those of the first.
    2. What is left are different contexts around the same anchor, and copies whose bytes were not equal. Their bytes come together by anchor, and
       their suffixes are sorted by hash comparison; of equal windows all but the first are covered, after
       comparing their bytes. Anchors with over ``bucket`` windows are dealt to buckets of documents, so no anchor has to fit one task. First
       windows of buckets that share two hashes then meet by their bytes.

    So bytes decide on every path; hashes (of ``context_bits`` bits) only choose what is compared.
    Matches never cross documents. Null texts are empty. Null ids come last. Rows of the same id and text are the same
    document and get the same spans; rows of the same id and other texts are documents ordered by a hash of the text.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("__doc"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    whole = docs.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "__id": F.col(id_col).cast("long"), "__text": F.col(text_col)})
    distinct = rows.groupBy("__doc").count().filter("count > 1").isEmpty()
    # Documents of one id are told apart by 32 bits of their text's hash; starts are below 2^31.
    tie = lambda text: F.lit(0).cast("long") if distinct else F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(0xFFFFFFFF)
    rows, whole = rows.withColumn("__tie", tie("text")), whole.withColumn("__tie", tie("__text"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            anchor, begin, size, doc, at, n, places = map(np.concatenate, held)
            context = context_hashes(np.concatenate(texts), begin, size) >> U(64 - context_bits)
            return arrays(RUN, anchor, context, doc, at, n, places)

        texts: list[np.ndarray] = []
        held: list[list[np.ndarray]] = [[] for _ in range(7)]
        size = count = 0
        for b in batches:
            for doc, tie, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (t.as_py() for t in b.column(2)), strict=True):
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) >= length:
                    anchor, start, n, places = anchor_runs(data, length)
                    for column, x in zip(held, (anchor, start + size, n - 1 + length, np.full(len(n), doc), start + (tie << 31), n, places), strict=True):
                        column.append(x)
                    texts.append(data)
                    size, count = size + len(data), count + len(n)
                if count > 50_000:
                    yield flush()
                    texts, held, size, count = [], [[] for _ in range(7)], 0, 0
        if count:
            yield flush()

    found = rows.select("__doc", "__tie", "text").mapInArrow(tidy(runs), RUN)
    shared = found.groupBy("anchor").agg(F.sum("places").alias("c")).filter("c > 1").select("anchor")
    several = found.join(shared, "anchor")
    several = materialize(several if distinct else several.dropDuplicates(["doc", "at"]), "runs")
    first = materialize(several.groupBy("anchor", "context").agg(F.min(F.struct("doc", "at", "n", "places")).alias("f")), "first")
    split = F.lit((1 << 31) - 1)
    upper = lambda c: F.shiftrightunsigned(c, 31)
    one = rows.dropDuplicates(["__doc", "__tie"]) if not distinct else rows

    # 1. Copies of first runs, neighbours joined where both sides go on.
    taken = several.join(first.select("anchor", "context", "f"), ["anchor", "context"]).filter("doc <> f.doc or at <> f.at").select("doc", "at", "n", "f")
    in_text = Window.partitionBy("doc", upper("at")).orderBy("at")
    goes_on = (F.lag("f.doc").over(in_text) == F.col("f.doc")) & (F.lag(F.col("at") + F.col("n")).over(in_text) == F.col("at")) & (F.lag(F.col("f.at") + F.col("n")).over(in_text) == F.col("f.at"))
    cuts = taken.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("new").over(in_text))
    pairs = cuts.groupBy("doc", upper("at").alias("tie"), "island").agg(F.min(F.struct("at", "f")).alias("a"), F.sum("n").alias("n")).select("doc", "a.at", "n", F.col("a.f.doc").alias("fdoc"), F.col("a.f.at").alias("fat"))
    pairs = materialize(pairs, "pairs")

    def sorted_runs(runs: DataFrame) -> DataFrame:
        """Wanted contexts (doc, at, n, anchor, buckets) of runs that share their anchor with another, or with themselves."""
        mixed = runs.groupBy("anchor").agg(F.sum("places").alias("c"), F.sum("n").alias("windows")).filter("c > 1").select("anchor", "windows")
        return runs.join(mixed, "anchor").select("doc", "at", "n", "anchor", F.ceil(F.col("windows") / bucket).alias("buckets"))

    def texts(wanted: DataFrame, label: str) -> DataFrame:
        """The bytes of wanted stretches: kind, doc, at, n (windows), and what came with them; each text is read once."""
        ours = wanted.select(F.col("doc").alias("__doc"), upper("at").alias("__tie"), F.struct("kind", F.col("at").bitwiseAND(split).alias("start"), "n", "anchor", "buckets", "fdoc", "fat").alias("r"))
        ours = ours.groupBy("__doc", "__tie").agg(F.collect_list("r").alias("wanted"))  # bounded by the document's length

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                held = 0
                for i in range(len(b)):
                    doc, tie, text, wanted = (b.column(k)[i].as_py() for k in range(4))
                    raw = text.encode("utf-8", "surrogatepass")
                    salt = int(mix(np.array([doc ^ tie], np.int64).view(U))[0])
                    for w in wanted:
                        bytes_ = raw[w["start"] : w["start"] + w["n"] - 1 + length]
                        out.append((w["kind"], w["anchor"], salt % (w["buckets"] or 1), w["buckets"], doc, w["start"] + (tie << 31), w["n"], w["fdoc"], w["fat"], bytes_))
                        held += len(bytes_)
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), CUT, strict=True)], schema=CUT)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), CUT, strict=True)], schema=CUT)

        cut_out = "kind int, anchor long, bucket long, buckets long, doc long, at long, n long, fdoc long, fat long, context binary"
        return materialize(one.join(ours, ["__doc", "__tie"]).select("__doc", "__tie", "text", "wanted").mapInArrow(tidy(cut), cut_out), label)

    none = F.lit(None).cast("long")
    runs_wanted = lambda runs: sorted_runs(runs).select(F.lit(0).alias("kind"), "doc", "at", "n", "anchor", "buckets", none.alias("fdoc"), none.alias("fat"))
    copies_wanted = pairs.select(F.lit(1).alias("kind"), "doc", "at", "n", none.alias("anchor"), none.alias("buckets"), "fdoc", "fat")
    firsts_wanted = pairs.select(F.lit(2).alias("kind"), F.col("fdoc").alias("doc"), F.col("fat").alias("at"), "n", none.alias("anchor"), none.alias("buckets"), none.alias("fdoc"), none.alias("fat")).distinct()
    firsts = first.select("anchor", "f.*")
    stretches = texts(runs_wanted(firsts).unionByName(copies_wanted).unionByName(firsts_wanted), "stretches")
    original = stretches.filter("kind = 2").select(F.col("doc").alias("fdoc"), F.col("at").alias("fat"), "n", F.col("context").alias("original"))
    compared = stretches.filter("kind = 1").join(original, ["fdoc", "fat", "n"]).select("doc", "at", "n", (F.col("context") == F.col("original")).alias("same"))
    compared = materialize(compared, "compared")
    contexts = stretches.filter("kind = 0")
    unequal = compared.filter("not same").select(F.col("doc").alias("udoc"), F.col("at").alias("uat"), F.col("n").alias("un"))
    if not unequal.isEmpty():  # hashes met by chance: these runs are sorted with the first ones
        again = several.join(unequal, (F.col("doc") == F.col("udoc")) & (F.col("at") >= F.col("uat")) & (F.col("at") < F.col("uat") + F.col("un"))).select("anchor", "doc", "at", "n", "places")
        contexts = texts(runs_wanted(firsts.union(again)), "contexts")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a bucket of an anchor come together; many buckets are sorted at once."""

        def flush() -> Iterator[pa.RecordBatch]:
            anchors, group, doc, at = (np.array([r[k] for r in held], np.int64) for k in (0, 1, 3, 4))
            of, place, start, again, s = repeated_windows(anchors.view(U), group, [r[5] for r in held], doc, at, length)
            yield arrays(OUT, *pad(spans_of(doc[of[again]], at[of[again]] + place[again])))
            many = ~again & (np.array([r[2] for r in held])[of] > 1)
            if many.any():
                x = start[many]
                yield arrays(OUT, doc[of[many]], at[of[many]] + place[many], np.ones(many.sum(), np.int64), span_hash(s.h, x, x + length), mix(span_hash(s.h, x, x + length // 2)))

        held, now, group, windows, size = [], None, 0, 0, 0
        for b in batches:
            for k in range(0, len(b), 1024):
                for r in zip(*(c.to_pylist() for c in b.slice(k, 1024).columns), strict=True):
                    if r[:2] != now:
                        if windows >= BATCH or size >= BATCH_BYTES:
                            yield from flush()
                            held, windows, size = [], 0, 0
                        now, group = r[:2], group + 1
                    held.append((r[0], group, *r[2:]))
                    windows, size = windows + len(r[5]) - length + 1, size + len(r[5])
        if held:
            yield from flush()

    # 2. Different contexts around one anchor.
    dealt = contexts.select("anchor", "bucket", "buckets", "doc", "at", "context").repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket", "doc", "at")
    sorted_ = materialize(dealt.mapInArrow(tidy(sort), OUT), "sorted")
    covered = compared.filter("same").select("doc", "at", "n").union(sorted_.filter("k1 is null").select("doc", "at", "n"))
    hot = sorted_.filter("k1 is not null")
    several_buckets = hot.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2")
    met = materialize(hot.join(several_buckets, ["k1", "k2"]).select("doc", "at"), "met")
    if not met.isEmpty():  # first windows of buckets: their own bytes are what they meet by
        alone = met.select(F.lit(3).alias("kind"), "doc", "at", F.lit(1).cast("long").alias("n"), *(none.alias(c) for c in ("anchor", "buckets", "fdoc", "fat")))
        windows = texts(alone, "windows").select("doc", "at", "n", "context")
        least = windows.groupBy("context").agg(F.min(F.struct("doc", "at")).alias("f"), F.count("*").alias("c")).filter("c > 1")
        covered = covered.union(windows.join(least, "context").filter("doc <> f.doc or at <> f.at").select("doc", "at", "n"))
    spans = covered.select(
        F.col("doc").alias("__doc"), upper("at").alias("__tie"), F.struct(F.col("at").bitwiseAND(split).alias("start"), (F.col("n") + length - 1).cast("long").alias("n")).alias("s")
    ).groupBy("__doc", "__tie").agg(F.collect_list("s").alias("__spans"))  # bounded by the document's length
    spans = materialize(spans, "spans")
    release(several, first, pairs, stretches, compared, sorted_, met)
    return whole.join(spans, ["__doc", "__tie"], "left").select(*keep, "__id", "__text", "__spans")


KINDS = {"kind": pa.int32(), **dict.fromkeys(("anchor", "bucket", "buckets", "doc", "at", "n", "fdoc", "fat"), pa.int64()), "context": pa.binary()}
CUT = pa.schema(KINDS)
OUT = "doc long, at long, n long, k1 long, k2 long"


def pad(spans: tuple[np.ndarray, ...]) -> tuple:
    none = np.full(len(spans[0]), None)
    return (*spans, none, none)


def mask(n: int, spans: Sequence[dict] | None) -> np.ndarray:
    """True for covered bytes."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["start"] + s["n"]] -= 1
    return np.cumsum(edge)[:n] > 0


def removals(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) for every document; see repeated_spans, also for settings."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 512):
                part, out = b.slice(k, 512), []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    gone = mask(len(raw), spans) if spans else None
                    if gone is None:
                        out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                    else:
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        out.append((len(raw), len(raw) - len(kept), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4], pa.binary())], names=KEPT)

    return repeated_spans(docs, length, id_col, text_col, **settings).mapInArrow(tidy(judge), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The same rows and columns, their texts without the characters that earlier strings cover (see repeated_spans).

    A character goes if all its bytes are covered. count_col, where there is one, gets the new length. Null texts stay null; no row goes.
    """
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, len(whole), 256)):
            texts = []
            for text, spans in zip(b.column("__text").to_pylist(), b.column("__spans").to_pylist(), strict=True):
                if text and spans:
                    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    first = np.flatnonzero((raw & 0xC0) != 0x80)
                    gone = np.repeat(np.minimum.reduceat(mask(len(raw), spans), first), np.diff(np.append(first, len(raw))))
                    text = raw[~gone].tobytes().decode("utf-8", "surrogatepass")
                texts.append(text)
            new = {text_col: pa.array(texts, pa.string())}
            if count_col in columns:
                new[count_col] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(count_col).type)
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in columns], names=columns)

    return repeated_spans(docs, length, id_col, text_col, columns).mapInArrow(tidy(cut), docs.schema)


KEPT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
