"""Byte-level BPE over a given vocabulary, merges chosen by a segment tree.

Each pre-token is a row of bytes.  A segment tree over the adjacent pairs keeps in
every node the smallest ``rank * width + position`` below it; its root is the
leftmost pair of lowest rank.  A merge touches three leaves, each repaired along
one path to the root, so a pre-token of n bytes costs n log n however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bound under which a vocabulary file is broadcast (public ones are about 1 MB).
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens remembered by a task.
CACHE_ENTRIES = 200_000

# Fixed value: the pre-token pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes -> id from lines ``base64 id``."""
    return {base64.b64decode(t): int(i) for t, i in map(bytes.split, raw.splitlines()) if t}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token, by leftmost lowest-rank merges."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1
    while width < n:
        width *= 2
    none = 1 << 62
    end = list(range(1, n + 1))  # end[i]: end of the token that starts at i
    before = list(range(-1, n - 1))  # start of the token before the one at i
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    def pair(i: int) -> int:
        j = end[i]
        if j >= n:
            return none
        r = ranks.get(piece[i : end[j]])
        return none if r is None else r * width + i

    while tree[1] != none:
        i = tree[1] % width
        j = end[i]
        end[i] = end[j]
        put(j, none)
        if end[i] < n:
            before[end[i]] = i
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def make_encoder(raw_vocabulary: bytes):
    """A function text -> ids with a cache of pre-tokens of its own."""
    ranks, split, cache = parse_ranks(raw_vocabulary), regex.compile(PATTERN), {}

    def encode(text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in split.findall(text or ""):
            got = cache.get(piece)
            if got is None:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                got = cache[piece] = encode_piece(piece.encode("utf-8", "replace"), ranks)
            ids += got
        return ids

    return encode


def broadcast_vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY):
    """The vocabulary file as a broadcast, after a check of its size."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


def token_ids(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row, without special tokens.

    Null and empty texts both give the empty list.  No shuffle: texts are encoded
    where they are read; long texts are encoded whole."""
    raw = broadcast_vocabulary(docs.sparkSession, vocabulary)

    def encode_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder(raw.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [encode(t) for t in b["text"]]})

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInPandas(encode_all, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``tokens``, the size of each text in tokens (0 for null)."""
    raw = broadcast_vocabulary(docs.sparkSession, vocabulary)
    src = docs.select(*keep, F.col(text_col).alias("__text"))

    def count_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder(raw.value)
        for b in batches:
            out = b[keep].copy()
            out["tokens"] = [len(encode(t)) for t in b["__text"]]
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep)
    return src.mapInPandas(count_all, f"{fields}, tokens bigint")
