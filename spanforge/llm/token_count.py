"""Token counts with a whole-token shortcut.

Offline, each vocabulary string is encoded by the merge rules alone; those that come out as one token, and that the
pre-tokeniser leaves in one piece, are proven. At run time a pre-token that is proven counts 1 without any merging; only the rest are merged
(by a compiled merger over the same ranks), once per distinct string and worker.

Defined results: null text counts as empty, with zeros; text is read whole; repeated rows each get their row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import arrow_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a worker keeps; beyond, it starts anew. Only speed depends on it.
MEMO = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one pre-token by byte-pair merging, lowest rank and leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    best = [get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
    while best:
        low = min(best)
        if low == 1 << 60:
            break
        i = best.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del best[i]
        if i < len(best):
            best[i] = get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            best[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
    return len(parts)


def prove_whole(ranks: dict[bytes, int], pattern: str = PATTERN) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that merging alone turns into one token."""
    split = regex.compile(pattern)
    proven = []
    for token in ranks:
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if split.findall(text) == [text] and merge_count(token, ranks) == 1:
            proven.append(text)
    return frozenset(proven)


class _Counts(dict):
    """Tokens per pre-token: proven ones from the start, others merged when first met."""

    def __init__(self, whole: frozenset[str], merge):
        super().__init__(dict.fromkeys(whole, 1))
        self.merge = merge

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.merge(piece.encode("utf-8")))
        return n


@lru_cache(maxsize=4)
def _tables(path: str, pattern: str):
    ranks = load_ranks(path)
    return ranks, prove_whole(ranks, pattern)


def count_tokens(docs: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, n_pretokens, n_whole, n_tokens) for each row of `docs`."""
    ranks, whole = _tables(vocabulary, pattern)
    held = docs.sparkSession.sparkContext.broadcast((ranks, whole))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, whole = held.value
        find = regex.compile(pattern).findall
        merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        counts = _Counts(whole, merge)
        for b in arrow_batches(batches):
            pre, single, total = [], [], []
            for text in b.column(1).to_pylist():
                pieces = find(text) if text else []
                each = list(map(counts.__getitem__, pieces))
                pre.append(len(pieces))
                total.append(sum(each))
                single.append(sum(map(whole.__contains__, pieces)))
                if len(counts) > len(whole) + MEMO:
                    counts = _Counts(whole, merge)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.array(x, np.int64)) for x in (pre, single, total))], [key, "n_pretokens", "n_whole", "n_tokens"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_pretokens long, n_whole long, n_tokens long")
