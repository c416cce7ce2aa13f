"""Problem 8: byte-level pair encoding of a whole corpus.

Each pre-token is merged with a segment tree over its byte positions whose
root holds the leftmost pair of the lowest rank; a merge updates three leaves.
Pre-tokens repeat, so a worker keeps the ids of those it has met.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.session import spread
from siltstone.sources.tables import table

TOKENIZER_DIR = os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")
#: Distinct pre-tokens a worker remembers; past that it starts afresh.
CACHE_ENTRIES = 400_000
# Unicode White_Space, as a character class.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TAIL = rf"[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_CLITIC = r"'(?:[sdmt]|ll|ve|re)"
_INF = 1 << 62


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = 1 << (n - 1).bit_length()
    tree = [_INF] * (2 * size)
    end = list(range(1, n + 1))  # where the part that starts here ends
    prev = list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i  # rank first, then position: the minimum is the leftmost lowest
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
            i >>= 1

    while (best := tree[1]) < _INF:
        i = best % size
        j = end[i]
        stop = end[i] = end[j]
        put(j, _INF)
        if stop < n:
            prev[stop] = i
            r = get(piece[i : end[stop]])
            put(i, _INF if r is None else r * size + i)
        else:
            put(i, _INF)
        p = prev[i]
        if p >= 0:
            r = get(piece[p:stop])
            put(p, _INF if r is None else r * size + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Text to ids by a rank file ``<name>.tiktoken``; no special tokens."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
        import regex

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # for ASCII texts the standard engine, which is faster, splits alike
        self.ascii = re.compile(rf"{_CLITIC}| ?[A-Za-z]+| ?[0-9]+| ?[^{_WS}A-Za-z0-9]+|{_TAIL}").findall
        self.wide = regex.compile(rf"{_CLITIC}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_TAIL}").findall
        self.known: dict[str, tuple[int, ...]] = {}

    def parts(self, text: str | None) -> list[tuple[int, ...]]:
        if not text:
            return []
        words = (self.ascii if text.isascii() else self.wide)(text)
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            pass
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = tuple(merge_ranks(w.encode(), self.ranks))
        return [known[w] for w in words]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, folder: str) -> Encoder:
    """One encoder per worker process."""
    if (name, folder) not in _ENCODERS:
        _ENCODERS[name, folder] = Encoder(name, folder)
    return _ENCODERS[name, folder]


def encode_corpus(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, ids`` of every row; NULL and empty texts have the empty list.

    Map-only: no shuffle, one output row per input row, repeated rows and NULL
    ids included. Only ``doc_id`` and ``text`` are read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                flat.extend(chain.from_iterable(enc.parts(text)))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return spread(docs.select("doc_id", "text")).mapInArrow(encode, "doc_id long, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
ORACLES: dict[str, str] = {}
