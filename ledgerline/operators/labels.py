"""Entry labelling: a linear-chain conditional random field in numpy, trained once, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let

# Spellings that mark pensioners, officials, widows and building sites.
PENSIONED = ("pens", "penſ")
OFFICIALS = ("geh", "wirkl")
WIDOWS = ("ww", "wwe", "vw", "verw")
SITES = ("Baustelle", "Baustellen", "Bauſtelle", "Bauſtellen", "Neubau", "Umbau", "Rohbau", "Rohbauten")

#: What is asked of each token, by the name of the attribute. Places in sentences of four are no matter of the token: see attributes().
TESTS: dict[str, Callable[[str], bool | str]] = {
    "repeated_name": lambda w: w.startswith(("—", "-")),
    "pens": lambda w: w.lower() in PENSIONED,
    "geh": lambda w: w.lower() in OFFICIALS,
    "widow": lambda w: w.lower() in WIDOWS,
    "digit": lambda w: any(c.isdigit() for c in w),
    "delimiter": lambda w: "." in w or "," in w,
    "start": lambda w: w == "START",
    "end": lambda w: w == "END",
    "lower": str.islower,
    "title": str.istitle,
    "upper": str.isupper,
    "from2": lambda w: w[2:],  # the word without its first letters, not its end
    "from1": lambda w: w[1:],
    "open": lambda w: w.startswith("("),
    "close": lambda w: w.endswith(")"),
    "street": lambda w: w.endswith(("str", "ſtr")),
    "site": lambda w: w in SITES,
}


def word_attributes(word: str) -> list[tuple[str, float]]:
    """(attribute, weight): truth values weigh 1 or 0, texts are attributes of their own."""
    out = []
    for name, test in TESTS.items():
        v = test(word)
        out.append((f"{name}:{v}", 1.0) if isinstance(v, str) else (name, float(v)))
    return out


def attributes(tokens: Sequence[str], reach: int = 2) -> list[dict[str, float]]:
    """Attributes of each token: those of itself and its neighbours, the ends of the sentence, and places in sentences of four."""
    words = [word_attributes(t) for t in tokens]
    out = []
    for i in range(len(tokens)):
        own = {f"{j - i}:{name}": w for j in range(max(0, i - reach), min(len(tokens), i + reach + 1)) for name, w in words[j]}
        own |= {k: 1.0 for k, here in (("BOS", i == 0), ("EOS", i == len(tokens) - 1), ("first_of_two", len(tokens) == 4 and i == 1), ("second_of_two", len(tokens) == 4 and i == 2)) if here}
        out.append(own)
    return out


#: Words whose attributes a task keeps, and tokens whose weights it sums at once.
KNOWN, BLOCK = 20_000, 4096


@dataclass
class Crf:
    """Weights of a trained model; small, and sent with the tasks."""

    labels: list[str]
    index: dict[str, int]
    state: np.ndarray  # attributes, labels
    move: np.ndarray  # labels, labels

    def __post_init__(self) -> None:
        self.known: dict[str, list[list[int]]] = {}

    def of(self, word: str, reach: int = 2) -> list[list[int]]:
        """The rows of a word's attributes at each distance from the token they are said of; kept for up to KNOWN words."""
        if word not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            names = [name for name, w in word_attributes(word) if w]
            self.known[word] = [[k for name in names if (k := self.index.get(f"{d}:{name}")) is not None] for d in range(-reach, reach + 1)]
        return self.known[word]

    def scores(self, tokens: Sequence[str], reach: int = 2) -> np.ndarray:
        """The sums of the weights of attributes(), in their order."""
        out, n = np.empty((len(tokens), len(self.labels))), len(tokens)
        places = {k: self.index[k] for k in ("BOS", "EOS", "first_of_two", "second_of_two") if k in self.index}
        for low in range(0, n, BLOCK):
            flat, ends = [], []
            high = min(n, low + BLOCK)
            near = [self.of(w) for w in tokens[max(0, low - reach) : high + reach]]
            base = max(0, low - reach)
            for i in range(low, high):
                for j in range(max(0, i - reach), min(n, i + reach + 1)):
                    flat += near[j - base][j - i + reach]
                here = (("BOS", i == 0), ("EOS", i == n - 1), ("first_of_two", n == 4 and i == 1), ("second_of_two", n == 4 and i == 2))
                flat += [places[k] for k, on in here if on and k in places]
                ends.append(len(flat))
            of, rows = np.repeat(np.arange(high - low), np.diff(ends, prepend=0)), np.array(flat, int)
            for y in range(len(self.labels)):  # bincount adds in the rows' order
                out[low:high, y] = np.bincount(of, self.state[rows, y], high - low)
        return out

    def predict(self, tokens: Sequence[str]) -> list[str]:
        """The likeliest sequence of labels (Viterbi)."""
        return self.predict_all([tokens])[0]

    def predict_all(self, sentences: Sequence[Sequence[str]]) -> list[list[str]]:
        """predict() of each sentence; those of one length together, for about BLOCK tokens at a time."""
        out: list[list[str]] = [[] for _ in sentences]
        lengths: dict[int, list[int]] = {}
        for k, tokens in enumerate(sentences):
            if len(tokens):
                lengths.setdefault(len(tokens), []).append(k)
        for n, which in lengths.items():
            step = max(1, BLOCK // n)
            for low in range(0, len(which), step):
                some = which[low : low + step]
                s = np.stack([self.scores(sentences[k]) for k in some], axis=1)  # place, sentence, label
                best, back = s[0], []
                for t in range(1, n):
                    through = best[:, :, None] + self.move
                    back.append(through.argmax(axis=1).astype(np.int32))
                    best = through.max(axis=1) + s[t]
                path, row = [best.argmax(axis=1)], np.arange(len(some))
                for b in reversed(back):
                    path.append(b[row, path[-1]])
                for k, labels in zip(some, np.stack(path[::-1], axis=1).tolist(), strict=True):
                    out[k] = [self.labels[y] for y in labels]
        return out


def train(sentences: Iterable[tuple[Sequence[str], Sequence[str]]], c1: float = 0.1, c2: float = 0.1, iterations: int = 1000, memory: int = 10) -> Crf:
    """Maximum likelihood with L1 weight c1 and L2 weight c2, by orthant-wise limited-memory quasi-Newton steps.

    Weights exist for (attribute, label) pairs and transitions seen in training. The labelled set is small and on the driver.
    """
    data = [(list(t), list(y)) for t, y in sentences if len(t)]
    labels = sorted({y for _, ys in data for y in ys})
    at = {y: k for k, y in enumerate(labels)}
    rows = [[{k: v for k, v in own.items() if v} for own in attributes(t)] for t, _ in data]
    index = {name: k for k, name in enumerate(sorted({n for s in rows for own in s for n in own}))}
    n, m = len(index), len(labels)
    gold = [np.array([at[y] for y in ys]) for _, ys in data]
    flat = [(np.concatenate([[index[k] for k in own] for own in s]).astype(int), np.concatenate([list(own.values()) for own in s]), np.repeat(np.arange(len(s)), [len(own) for own in s])) for s in rows]
    seen_state, seen_move, count_state, count_move = np.zeros((n, m), bool), np.zeros((m, m), bool), np.zeros((n, m)), np.zeros((m, m))
    for (a, v, t), y in zip(flat, gold, strict=True):
        np.add.at(count_state, (a, y[t]), v)
        seen_state[a, y[t]] = True
        np.add.at(count_move, (y[:-1], y[1:]), 1)
        seen_move[y[:-1], y[1:]] = True
    mask = np.concatenate([seen_state.ravel(), seen_move.ravel()])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        state, move = x[: n * m].reshape(n, m), x[n * m :].reshape(m, m)
        value, g_state, g_move = 0.0, -count_state, -count_move
        g_state, g_move = g_state.copy(), g_move.copy()
        for (a, v, t), y in zip(flat, gold, strict=True):
            s = np.zeros((len(y), m))
            np.add.at(s, t, v[:, None] * state[a])
            f, b = np.zeros_like(s), np.zeros_like(s)
            f[0] = s[0]
            for k in range(1, len(y)):
                f[k] = s[k] + log_sum(f[k - 1][:, None] + move, 0)
            for k in range(len(y) - 2, -1, -1):
                b[k] = log_sum(move + (s[k + 1] + b[k + 1])[None, :], 1)
            z = log_sum(f[-1], 0)
            value += z - s[np.arange(len(y)), y].sum() - move[y[:-1], y[1:]].sum()
            p = np.exp(f + b - z)
            np.add.at(g_state, a, v[:, None] * p[t])
            for k in range(1, len(y)):
                g_move += np.exp(f[k - 1][:, None] + move + (s[k] + b[k])[None, :] - z)
        g = np.where(mask, np.concatenate([g_state.ravel(), g_move.ravel()]), 0) + 2 * c2 * x
        return value + c2 * float(x @ x), g

    x = orthant_wise(loss, np.zeros(n * m + m * m), c1, iterations, memory)
    return Crf(labels, index, x[: n * m].reshape(n, m), x[n * m :].reshape(m, m))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis=axis) + np.log(np.exp(x - top).sum(axis=axis))


def orthant_wise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, c1: float, iterations: int, memory: int, tolerance: float = 1e-5) -> np.ndarray:
    """Minimize loss(x) + c1 |x|_1: quasi-Newton steps from the pseudo-gradient, kept within their orthant."""
    value, g = loss(x)
    total, pairs = value + c1 * np.abs(x).sum(), []
    for _ in range(iterations):
        low, high = g - c1, g + c1
        slope = np.where(x < 0, low, np.where(x > 0, high, np.where(high < 0, high, np.where(low > 0, low, 0))))
        if np.linalg.norm(slope) < tolerance * max(1.0, np.linalg.norm(x)):
            break
        d, alphas = -slope, []
        for s, y, r in reversed(pairs):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y, r), a in zip(pairs, reversed(alphas), strict=True):
            d = d + s * (a - r * (y @ d))
        d = np.where(d * slope < 0, d, 0)
        side, step = np.where(x != 0, np.sign(x), np.sign(-slope)), 1.0 if pairs else 1 / max(np.linalg.norm(slope), 1e-12)
        for _ in range(40):
            new = x + step * d
            new = np.where(new * side >= 0, new, 0)
            v, h = loss(new)
            t = v + c1 * np.abs(new).sum()
            if t <= total + 1e-4 * (slope @ (new - x)):
                break
            step /= 2
        else:
            break
        s, y = new - x, h - g
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = abs(total - t) < 1e-9 * max(1.0, abs(total))
        x, g, total = new, h, t
        if done:
            break
    return x


def labeller(model: Crf) -> Callable[[Column | str], Column]:
    """A column function: array of tokens -> array of labels."""

    @F.pandas_udf("array<string>")
    def predict(tokens: pd.Series) -> pd.Series:
        found = model.predict_all([() if t is None else list(t) for t in tokens])
        return pd.Series([None if t is None else y for t, y in zip(tokens, found, strict=True)], dtype=object)

    return predict


CATEGORIES = "struct<subjects:array<string>, occupations:array<string>, other:array<string>, proprietor:array<string>, absentee:array<struct<value:string, labels:array<string>>>>"
def runs(tokens: Column | str, labels: Column | str) -> Column:
    """Runs of tokens of one label that another label ends, as (label, value): the last run is never ended, so it is not there."""
    t, y = (F.col(c) if isinstance(c, str) else c for c in (tokens, labels))
    pairs = F.arrays_zip(t.alias("t"), y.alias("l"))
    kind = "array<struct<label:string, value:string>>"
    start = F.struct(F.lit(None).cast("string").alias("label"), F.lit("").alias("value"), F.array().cast(kind).alias("done"))

    def step(s: Column, x: Column) -> Column:
        same = s["label"].eqNullSafe(x["l"])
        ended = F.when(same | s["label"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["label"].alias("label"), s["value"].alias("value")))))
        return F.struct(x["l"].alias("label"), F.when(same, F.concat(s["value"], F.lit(" "), x["t"])).otherwise(x["t"]).alias("value"), ended.alias("done"))

    return F.aggregate(pairs, start, step, lambda s: s["done"])


def reduce_labels(tokens: Column | str, labels: Column | str) -> Column:
    """Runs by category (CATEGORIES): N subjects, O occupations, S other, P proprietor, A absentee.

    PA runs before an A run are what is said of it: joined as they are and split again at ``' .'``. Other labels are dropped.
    """
    return let(runs(tokens, labels), categories)


def categories(found: Column) -> Column:
    """CATEGORIES of runs()."""
    of = lambda label: F.transform(F.filter(found, lambda r: r["label"] == label), lambda r: r["value"])
    kind = "array<struct<value:string, labels:array<string>>>"
    start = F.struct(F.lit("").alias("said"), F.array().cast(kind).alias("out"))

    def step(s: Column, r: Column) -> Column:
        parts = F.when(s["said"] != "", F.filter(F.split(s["said"], r" \."), lambda x: x != ""))
        place = F.struct(r["value"].alias("value"), parts.alias("labels"))
        said = F.when(r["label"] == "PA", F.concat(s["said"], r["value"])).when(r["label"] == "A", F.lit("")).otherwise(s["said"])
        return F.struct(said.alias("said"), F.when(r["label"] == "A", F.concat(s["out"], F.array(place))).otherwise(s["out"]).alias("out"))

    absent = F.aggregate(found, start, step, lambda s: s["out"])
    return F.struct(of("N").alias("subjects"), of("O").alias("occupations"), of("S").alias("other"), of("P").alias("proprietor"), absent.alias("absentee"))


def parse_entries(lines: DataFrame, model: Crf) -> DataFrame:
    """Adds tokens, labels and categories to every line."""
    from ..functions.text import tokenize

    labelled = lines.withColumn("tokens", tokenize("content", ends=True))
    labelled = labelled.withColumn("labels", labeller(model)("tokens"))
    return labelled.withColumn("categories", reduce_labels("tokens", "labels"))


def occupations(entries: DataFrame, sanitized: bool = False) -> DataFrame:
    """One row per occupation of a line, in order: page, column, line, occ_idx, street, number, occupation. Lines not parsed give none."""
    from ..functions.text import sanitize

    rows = entries.select("page_idx", "col_idx", "line_idx", "street", "number", F.posexplode("categories.occupations").alias("occ_idx", "occupation"))
    return rows.withColumns({c: sanitize(c) for c in ("street", "number", "occupation")}) if sanitized else rows


def sentences(rows: DataFrame) -> DataFrame:
    """(sentence_no, tokens, labels) from rows sentence_no, pos, token, label."""
    ordered = rows.groupBy("sentence_no").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "label"))).alias("w"))
    return ordered.select("sentence_no", F.transform("w", lambda x: x["token"]).alias("tokens"), F.transform("w", lambda x: x["label"]).alias("labels"))


def confusion_rows(gold: DataFrame, model: Crf) -> DataFrame:
    """(gold, predicted) for each token of labelled sentences."""
    both = gold.withColumn("p", labeller(model)("tokens"))
    return both.select(F.explode(F.arrays_zip(F.col("labels").alias("gold"), F.col("p").alias("predicted"))).alias("x")).select("x.gold", "x.predicted")
