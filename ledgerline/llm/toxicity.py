"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

WINDOW = 64
#: Size of the ordinary dictionary and its segments, largest size of the toxic one and its segments, in bytes.
ORDINARY, TOXIC = (262_144, 24), (8192, 16)
#: Bytes of toxic windows for each byte of the toxic dictionary, as what fewer windows have in common takes less of it, and its least size.
SHARE, LEAST = 4, 2048
#: Rounds of training: the size of the windows, and the percentile of the ordinary windows' gains that toxic windows must exceed to stay.
ROUNDS = ((64, 90), (24, 98))
#: Gains in bytes that windows are counted at.
STEPS = (1, 2, 3, 4, 5, 7)
#: The last bytes before a trained dictionary's content.
OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


@dataclass
class Model:
    """Everything a task needs; some 400 kB."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The whole text, lower-cased, in pieces of whole words of ``size`` bytes or little more; words of over four times that are cut."""
    out, held, n = [], [], 0
    for word in (text or "").lower().encode("utf-8", "surrogatepass").split():
        for k in range(0, len(word), 4 * size):
            part = word[k : k + 4 * size]
            held.append(part)
            n += len(part) + 1
            if n >= size:
                out.append(b" " + b" ".join(held) + b" ")
                held, n = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def trained_toxic(samples: Sequence[bytes]) -> bytes:
    return trained(samples, min(TOXIC[0], max(LEAST, sum(map(len, samples)) // SHARE)), TOXIC[1]) if samples else b""


def trained(samples: Sequence[bytes], size: int, segment: int) -> bytes:
    """The content of a zstandard dictionary of the samples, without its tables; the samples themselves where they fit, or where the trainer finds them too few."""
    import zstandard as z

    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    try:
        return z.train_dictionary(size, list(samples), k=segment, d=6).as_bytes().split(OFFSETS, 1)[-1]
    except z.ZstdError:
        return b"".join(samples)[-size:]


class Gains:
    """How many bytes shorter the toxic dictionary makes windows than the ordinary one does.

    The toxic dictionary lies before the ordinary one, whose bytes both have at the end, as raw content: so the lengths of a
    window agree unless a segment of the toxic one is nearer to it than anything in the ordinary one.
    """

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.plain, self.both = self.compressor(ordinary), self.compressor(toxic + ordinary)

    @staticmethod
    def compressor(content: bytes):  # noqa: ANN205
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(5, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
        words = z.ZstdCompressionDict(content.rjust(8), dict_type=z.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=params)
        return z.ZstdCompressor(dict_data=words, compression_params=params).compress

    def of(self, pieces: Sequence[bytes]) -> np.ndarray:
        return np.array([len(self.plain(w)) - len(self.both(w)) for w in pieces], float)


def train_dictionaries(toxic: Sequence[str], ordinary: Sequence[str]) -> tuple[bytes, bytes]:
    """Dictionaries (toxic, ordinary), each trained on windows of its class.

    Most windows of a toxic document are ordinary. So either class is halved, and each half's windows are compressed with the
    dictionaries of the other half: toxic windows stay if they gain more than nearly all ordinary ones do, and the next toxic
    dictionary is trained on these; ordinary windows that gain too go into the next ordinary dictionary as well, so
    that they no longer do.
    """
    halves = lambda docs: [[w for t in docs[k::2] for w in windows(t)] for k in (0, 1)]
    bad, good = halves(sorted(set(toxic))), halves(ordinary)
    tox, plain = [trained(x, *TOXIC) for x in bad], [trained(x, *ORDINARY) for x in good]
    hard: list[list[bytes]] = [[], []]
    for size, percentile in ROUNDS:
        bad, other = ([[p for w in x[k] for p in windows(w.decode("utf-8", "replace"), size)] for k in (0, 1)] for x in (bad, good))
        scales = [Gains(t, o) for t, o in zip(tox, plain, strict=True)]
        gain, wrong = ([scales[1 - k].of(x[k]) for k in (0, 1)] for x in (bad, other))
        all_ = np.concatenate([*wrong, [0.0]])
        least, near = max(2, np.percentile(all_, percentile)), max(2, np.percentile(all_, 90))
        bad = [[bad[k][i] for i in np.flatnonzero(gain[k] > least)] for k in (0, 1)]
        hard = [hard[k] + [other[k][i] for i in np.flatnonzero(wrong[k] >= near)] for k in (0, 1)]
        tox = [trained_toxic(x) for x in bad]
        plain = [trained(hard[k], ORDINARY[0] // 2, ORDINARY[1]) + trained(good[k], *ORDINARY) for k in (0, 1)]
    return trained_toxic(bad[0] + bad[1]), trained(hard[0] + hard[1], ORDINARY[0] // 2, ORDINARY[1]) + trained(good[0] + good[1], *ORDINARY)


def features(gains: np.ndarray) -> list[float]:
    """What a document's windows say: how many gain each of STEPS or more, the share of 3 or more, the largest gain, the number."""
    if not len(gains):
        return [1.0] + [0.0] * (len(STEPS) + 3)
    over = [np.log1p((gains >= k).sum()) for k in STEPS]
    return [1.0, *over, np.log1p(100 * (gains >= 3).mean()), gains.max() / 4, np.log1p(len(gains))]


def fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; share: each row's weight."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (share * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(toxic: Sequence[str], ordinary: Sequence[str], odds: float = 1.0) -> Model:
    """Dictionaries from two thirds of the sample; the calibration, a logistic curve over features(), from the rest.

    odds: ordinary labelled documents for each toxic one, which the calibration's classes are weighted to. Without toxic or
    ordinary documents the score is the toxic share.
    """
    cut = lambda docs: ([t for k, t in enumerate(docs) if k % 3], [t for k, t in enumerate(docs) if k % 3 == 0])
    (a, b), (c, d) = cut(toxic), cut(ordinary)
    if not (a and c):
        share = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
        return Model(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * (len(STEPS) + 3)))
    tox, plain = train_dictionaries(a, c)
    gains = Gains(tox, plain)
    x = np.array([features(gains.of(windows(t))) for t in (*b, *d)])
    y = np.repeat([1.0, 0.0], [len(b), len(d)])
    return Model(tox, plain, tuple(fit(x, y, np.where(y == 1, 1.0, odds * len(b) / len(d)))))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = 3000, longest: int = 20_000, fold: int = 1) -> tuple[list[str], list[str], float]:
    """Texts of per_class toxic and per_class ordinary labelled documents at most, of up to ``longest`` characters; ordinary labels for each toxic one.

    Documents whose crc32(doc_id as text) mod 3 is ``fold`` are held out. The smallest hashes of doc_id are taken, and of several
    texts of one id the least, so the sample is the same on every run and bounded by 2 * per_class * longest. The odds are counted over all labels.
    """
    order = F.xxhash64(F.lit("sample"), "doc_id")
    rows = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != fold)
    count = rows.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    picked = [rows.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_class) for y in (1, 0)]
    # 2 * per_class ids at most, hence the broadcast, and the least text of each.
    found = (
        docs.select("doc_id", "text").filter(F.length("text") <= longest)
        .join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .collect()
    )
    found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    bad = count["bad"] or 0
    return [r["text"] for r in found if r["toxic"] == 1], [r["text"] for r in found if r["toxic"] == 0], (count["n"] - bad) / bad if bad else 1.0


def scores(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``keep`` columns and score of each document, from its whole text alone. score_col: a name that no kept column has."""
    schema = docs.select(*keep).withColumn(score_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, w = Gains(model.toxic, model.ordinary), np.array(model.weights)
        for b in batches:
            x = np.array([features(gains.of(windows(t.as_py()))) for t in b.column(b.num_columns - 1)]).reshape(-1, len(w))
            score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*b.schema.names[:-1], score_col])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 3000, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The model is trained on a bounded sample of labelled documents outside the fold (see sample);
    scores come from the text only. Null and empty texts get the score of a text without windows; repeated
    rows are scored alike; null ids are never held out. An empty table gives no rows.
    """
    model = train(*sample(docs, labels, per_class, fold=fold))
    out = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
