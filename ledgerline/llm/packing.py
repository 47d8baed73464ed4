"""Packing documents into token sequences of balanced attention cost."""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def balanced(lengths: Iterable[int], capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block of documents.

    The block gets as few sequences as its tokens need. Documents longer than a sequence first give off full
    sequences. The rest go, by descending cost (linear n + quadratic n^2), to the sequence of the
    lowest cost with capacity left; what does not fit there goes on to the next such sequence, so
    all sequences of a block but the tokens short of a last one are full.
    """
    lengths = list(lengths)
    pieces, rest, used = [], [], 0
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            pieces.append((d, at, capacity, used, 0))
            at, used = at + capacity, used + 1
        if n > at:
            rest.append((n - at, d, at))
    rest.sort(key=lambda r: (-r[0], r[1]))
    open_ = [(0.0, used + k, 0) for k in range(-(-sum(n for n, _, _ in rest) // capacity))]
    for n, d, at in rest:
        while n:
            cost, seq, full = heapq.heappop(open_)
            part = min(n, capacity - full)
            pieces.append((d, at, part, seq, full))
            n, at = n - part, at + part
            if full + part < capacity:
                heapq.heappush(open_, (cost + linear * part + quadratic * part * part, seq, full + part))
    return pieces


#: Letters whose lower case and composition don't depend on their neighbours (U+0130 has a lower case of two).
LATIN = re.compile("[A-Za-z\u00c0-\u012f\u0131-\u0148\u014a-\u024f]+").fullmatch


class Words:
    """Token ids as little-endian bytes, by white-space separated chunk, with a bounded cache.

    The tokenizer drops white space and no token crosses it, so the chunks' ids joined are the
    text's ids. Latin words, in lower case and with their bytes mapped as the tokenizer does it, go
    many at a time to its BPE model alone; each ends with one word-end token, which is where their ids
    are told apart. All other chunks are encoded by the whole tokenizer, each by itself.
    """

    def __init__(self, path: str, size: int = 700_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.size = Tokenizer.from_file(path), size
        model = json.loads(self.tokenizer.to_str())
        model |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(model))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: 256 + k for k, b in enumerate(hidden)}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for word, k in vocab.items():
            self.ends[k] = word.endswith("</w>")
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The texts' ids; what none of them has had before is encoded in one call."""
        words = [t.replace("\n", " ").split(" ") for t in texts]
        missing = set().union(*words).difference(self.young)
        if missing:
            self.learn(sorted(missing), words)
        young = self.young
        return [b"".join([young[w] for w in ws]) for ws in words]

    def learn(self, missing: list[str], words: list[list[str]]) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {"": b""}
            missing = sorted(set().union(*words) - {""})
        young, old, new, plain = self.young, self.old, [], {}
        for w in missing:
            if (known := old.get(w)) is not None:
                young[w] = known
                continue
            new.append(w)
            base = w[:-1] if w[-1] in ",." else w
            if base not in young and (base.isascii() or LATIN(base)) and base.isalpha():
                low = base.lower()
                plain.setdefault(low if base.isascii() else low.encode().decode("latin-1").translate(self.bytes), []).append(base)
        if plain:
            ids = np.array(self.model.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            raw, at, cut = ids.tobytes(), 0, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            for same, end in zip(plain.values(), cut, strict=True):
                for w in same:
                    young[w] = raw[at:end]
                at = end
        for w in new:
            if w not in young:
                if w[-1] in ",." and w[:-1] in young:
                    if w[-1] not in young:
                        young[w[-1]] = self.encode(w[-1])
                    young[w] = young[w[:-1]] + young[w[-1]]
                else:
                    young[w] = self.encode(w)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def words_of(path: str, size: int) -> Words:
    """One per Python worker, kept from task to task, without the memory that only its making takes."""
    words = Words(path, size)
    give_back()
    return words


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    block_tokens: int = 8_000_000,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    cached_words: int = 700_000,
) -> DataFrame:
    """Tokenize every document, end it with end_id and pack all into sequences of capacity tokens.

    Each input partition is packed by itself in blocks of about block_tokens tokens, so nothing
    is shuffled, memory is bounded, and a lost task gives the same sequences when it runs again. A Python worker
    keeps the ids of twice cached_words words at most.
    sequence_id is partition * 2^33 + number. At most one sequence's worth of padding per block.

    Null and empty texts are the end token alone; repeated rows are packed each; null ids stay
    null. An empty table gives no rows. Other columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, base = words_of(tokenizer_path, cached_words), TaskContext.get().partitionId() << 33
        names, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            out = []
            for d, at, n, seq, offset in balanced([len(t) // 4 for t in texts], capacity, linear, quadratic):
                out.append((names[d], at, n, zlib.crc32(texts[d][4 * at : 4 * (at + n)]), len(texts[d]) // 4, base + seq, offset))
            base = max(r[5] for r in out) + 1
            names.clear()
            texts.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                names += part.column(0).to_pylist()
                texts += [t + end for t in words.ids([t or "" for t in part.column(1).to_pylist()])]
                held += sum(map(len, texts[-len(part) :])) // 4
                if held >= block_tokens:
                    yield flush()
        if names:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), SCHEMA)
