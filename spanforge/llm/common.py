"""Helpers shared by the training-data operators: shared storage, sized broadcasts, vectorised tokens."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A table is broadcast up to this many bytes; beyond, the same result comes from a shuffle join.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Write `df` to `path`, partitioned by columns if named. Its shuffle files go as soon as the table is there: nothing reads them again."""
    spark, switch = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(switch, "false")
    spark.conf.set(switch, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(switch, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and lost executors cost nothing that was done."""
    path = fresh_path(df.sparkSession, name)
    write_table(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared one, if it is there."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again: what was made of them must be stored by now."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def sized(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if its counted rows fit the limit, else as it is. Give it a materialized table."""
    return F.broadcast(df) if df.count() * row_bytes <= (BROADCAST_BYTES if limit is None else limit) else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{base}", 0
    while name.lower() in taken:
        name, k = f"__{base}{k}", k + 1
    return name


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_EDGE = re.compile(r"^\W+|\W+$")


def trim_word(word: str) -> str:
    return word if word.isalnum() else _EDGE.sub("", word)


def hash_words(words: list[str]) -> np.ndarray:
    """Seedless 64-bit hashes of strings, alike in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


class Tokens:
    """Lower-cased white-space tokens of a batch of texts: distinct words, an index per token, and row offsets."""

    def __init__(self, texts: pa.Array, trim: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        if trim:
            first: dict[str, int] = {}
            back = np.fromiter((first.setdefault(trim_word(w), len(first)) for w in words), np.int64, len(words))
            words, ids = list(first), back[ids] if len(ids) else ids
        else:
            first = {w: i for i, w in enumerate(words)}
        blank = first.get("")
        if blank is not None:
            keep = ids != blank
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            ids = ids[keep]
        self.words, self.ids, self.offsets = words, ids, offsets
        self.lengths = np.diff(offsets)

    @property
    def rows(self) -> np.ndarray:
        """The row of each token."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def ngram_hashes(tokens: Tokens, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word n-gram within a row; with `short`, a row of fewer words gives one shorter gram."""
    hashes = hash_words(tokens.words)
    h = hashes[tokens.ids] if len(tokens.ids) else np.zeros(0, np.uint64)
    rows = tokens.rows
    g, keep = h.copy(), np.ones(len(h), bool)
    inside = np.arange(len(h)) - np.repeat(tokens.offsets[:-1], tokens.lengths)
    left = np.repeat(tokens.lengths, tokens.lengths) - inside
    for k in range(1, n):
        nxt = np.zeros_like(h)
        if k < len(h):
            nxt[:-k] = h[k:]
        has = left > k
        g = np.where(has, mix64(g * np.uint64(31) + nxt), g)
        keep &= has
    if short:
        keep |= (inside == 0) & (np.repeat(tokens.lengths, tokens.lengths) < n)
    return rows[keep], g[keep] ^ np.uint64(n)


def release_memory() -> None:
    """Give freed memory back to the system, so that a worker's size follows what it holds and not what it held once."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `max_bytes` at most (a single longer row stays whole)."""
    for b in batches:
        parts = max(1, min(b.num_rows, -(-b.nbytes // max_bytes)))
        step = -(-b.num_rows // parts) if b.num_rows else 1
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
            release_memory()
