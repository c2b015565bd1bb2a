"""Language-model scoring over a log-frequency Bloom filter.

Word n-gram counts of the whole corpus are quantised to levels (level q stands for counts of [b^(q-1), b^q)).
An n-gram of level q puts the keys (gram, 1) ... (gram, q) into a Bloom filter; its level is read back by probing
j = 1, 2, ... until a key is absent. Scores interpolate the n-gram estimates recursively with add-one unigrams.

The filter grows with the corpus, so it has no bound under which it could be broadcast. It is cut into segments by gram
hash instead, and there is one plan for all sizes: text is cut into stored blocks; a block sends its distinct grams (with
their counts, to fit) to their segments as packed arrays; a segment builds or loads its filter, probes it once for each
distinct gram and sends one byte per gram back; a block then looks up its positions in the levels that came back. Nothing travels
per token, and a hot gram is one entry per block. Only a model's totals come to the driver.

Defined results: null or blank text gives n_tokens 0 and null scores; text is read whole whatever its length; repeated
rows count each time and each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, arrow_batches, fresh_path, materialize, mix64, ngram_hashes, release_memory, write_table

U = np.uint64
BITS_PER_KEY, PROBES = 10, 7
#: Grams (with one entry per block) that a segment holds on average, bytes of text in a block, and in the slices of a block that are tokenised at once.
SEGMENT_GRAMS, BLOCK_BYTES, SLICE_BYTES = 1 << 21, 8 << 20, 4 << 20
#: Grams are told apart by this many bits: 10^13 of them share a hash with a chance of 0.2 %, a fraction of the filter's own error.
GRAM_BITS = 52


def gram_levels(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base(count)), without float trouble at the powers."""
    q = 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base)).astype(np.int64)
    q += np.power(base, q.astype(float)) <= counts
    q -= np.power(base, (q - 1).astype(float)) > counts
    return q


def level_count(levels: np.ndarray, base: float) -> np.ndarray:
    """The count that stands for a level: the middle of its integers; 0 for level 0."""
    low = np.ceil(np.power(base, levels - 1.0))
    high = np.maximum(low, np.ceil(np.power(base, levels * 1.0)) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _segment_bits(h: np.ndarray, q: np.ndarray) -> tuple[int, bytes]:
    keys = int(q.sum())
    m = max(64, -(-keys * BITS_PER_KEY // 64) * 64)
    bits = np.zeros(m, np.uint8)
    for j in range(1, int(q.max()) + 1 if len(q) else 1):
        live = h[q >= j]
        for p in _probes(live, j, m):
            bits[p] = 1
    return m, np.packbits(bits, bitorder="little").tobytes()


def _probes(h: np.ndarray, level: int, m: int) -> Iterator[np.ndarray]:
    a = mix64(h + U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    b = mix64(a) | U(1)
    for i in range(PROBES):
        yield ((a + U(i) * b) >> U(1)) % U(m)


class BloomTable:
    """One segment of the filter: reads levels for arrays of gram hashes by repeated membership probes."""

    def __init__(self, size: int, bits: np.ndarray):
        self.size, self.bits = size, bits

    def has(self, h: np.ndarray, level: int) -> np.ndarray:
        ok = np.full(len(h), self.size > 0)
        at = np.flatnonzero(ok)
        a = mix64(h[at] + U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        b = mix64(a) | U(1)
        for i in range(PROBES):
            p = ((a + U(i) * b) >> U(1)) % U(max(1, self.size))
            hit = (self.bits[(p >> U(3)).astype(np.int64)] >> (p & U(7)).astype(np.uint8)) & 1 > 0
            ok[at[~hit]] = False
            at, a, b = at[hit], a[hit], b[hit]
        return ok

    def levels(self, h: np.ndarray) -> np.ndarray:
        q = np.zeros(len(h), np.int64)
        at, level = np.arange(len(h)), 1
        while len(at):
            at = at[self.has(h[at], level)]
            q[at] = level
            level += 1
        return q


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """By the hash's upper bits, so that sorted grams are in order of their segments."""
    return (((h >> U(GRAM_BITS - 32)) * U(segments)) >> U(32)).astype(np.int64)


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte, compressed."""
    d = np.diff(a, prepend=U(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def position_grams(t: Tokens, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 ... order: (positions, gram) of the n-grams that end at a token. The lowest bit tells single words from longer grams."""
    where = gram_ends(t.lengths, order)
    return [(where[n - 1], ((ngram_hashes(t, n)[1] >> U(64 - GRAM_BITS)) & ~U(1)) | U(n == 1)) for n in range(1, order + 1)]


def gram_ends(lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 ... order: positions of the tokens at which an n-gram of their row ends."""
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return [np.flatnonzero(inside >= n - 1) for n in range(1, order + 1)]


def text_blocks(docs: DataFrame, key: str) -> DataFrame:
    """(p, block, data): the rows' keys and texts in blocks of about BLOCK_BYTES, stored, so that every later pass sees the same blocks."""
    kind = docs.select(key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def cut():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["p", "block", "data"])

        for b in arrow_batches(batches, SLICE_BYTES):
            if held and size + b.nbytes > BLOCK_BYTES:
                yield cut()
                block, held, size = block + 1, [], 0
            held.append(b)
            size += b.nbytes
        if held:
            yield cut()

    assert len(kind) == 1
    return materialize(docs.select(key, "text").mapInArrow(run, "p long, block long, data binary"), "lmblocks")


def _slices(data: pa.BinaryScalar) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(data.as_buffer())


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes with their counts, of several such pairs."""
    if len(parts) == 1:
        return parts[0]
    h, k = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h = h[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[start], np.add.reduceat(k[order], start) if len(h) else k


def _distinct(arrays: list[np.ndarray]) -> np.ndarray:
    h = np.sort(np.concatenate(arrays))
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


class Model:
    """What a fitted filter is: the folder of segment files (none if the filter answered its own corpus only) and a few totals."""

    def __init__(self, path: str | None, segments: int, order: int, base: float, tokens: int, vocabulary: int):
        self.path, self.segments, self.order, self.base, self.tokens, self.vocabulary = path, segments, order, base, tokens, vocabulary

    def read(self, segment: int) -> BloomTable:
        fs, root = pafs.FileSystem.from_uri(self.path)
        name = f"{root}/seg-{segment:06d}.bits"
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            return BloomTable(0, np.zeros(1, np.uint8))
        with fs.open_input_stream(name) as f:
            bits = np.frombuffer(f.read(), np.uint8)
        return BloomTable(len(bits) * 8, bits)


def questions(blocks: DataFrame, order: int, segments: int) -> DataFrame:
    """(seg, p, block, grams, counts): each block's distinct grams by segment, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                parts = [np.unique(np.concatenate([g for _, g in position_grams(Tokens(x.column("text")), order)]), return_counts=True) for x in _slices(data)]
                u, k = _merged(parts)
                cuts = np.searchsorted(segment_of(u, segments), np.arange(segments + 1)) if len(u) else np.zeros(segments + 1, np.int64)
                seg = np.flatnonzero(np.diff(cuts))
                grams = [pack_sorted(u[cuts[s] : cuts[s + 1]]) for s in seg]
                counts = [zstandard.compress(k[cuts[s] : cuts[s + 1]].astype(np.int32).tobytes(), 1) for s in seg]
                n = len(seg)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg), pa.array(np.full(n, p, np.int64)), pa.array(np.full(n, block, np.int64)), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())],
                    ["seg", "p", "block", "grams", "counts"],
                )
                release_memory()

    return blocks.mapInArrow(run, "seg long, p long, block long, grams binary, counts binary")


_ANSWER = "p long, block long, seg long, levels binary, tokens long, words long"


def answers(asked: DataFrame, segments: int, base: float, store: str | None = None, model: Model | None = None) -> DataFrame:
    """Segments at work: each builds its filter from the counts it gets (or loads that of `model`), stores it under `store` if wanted,
    and answers every block with levels in the order of its grams. A segment's totals are in the first of its rows."""

    def segment(s, held):
        tokens = words = 0
        if model:
            u, table = _distinct([x[2] for x in held]), model.read(s)
        else:
            u, k = _merged([(g, np.frombuffer(zstandard.decompress(c), np.int32).astype(np.int64)) for _, _, g, c in held])
            size, data = _segment_bits(u, gram_levels(k, base))
            table, one = BloomTable(size, np.frombuffer(data, np.uint8)), u & U(1) > 0
            tokens, words = int(k[one].sum()), int(one.sum())
            if store:
                # equal input gives equal bytes, so a task that runs again only rewrites the same file
                fs, root = pafs.FileSystem.from_uri(store)
                tmp = f"{root}/.{s}-{np.random.default_rng().integers(1 << 62)}"
                with fs.open_output_stream(tmp) as f:
                    f.write(data)
                fs.move(tmp, f"{root}/seg-{s:06d}.bits")
        level = table.levels(u).astype(np.uint8)
        for i, (p, block, g, _) in enumerate(held):
            yield p, block, s, zstandard.compress(level[np.searchsorted(u, g)].tobytes(), 1), tokens * (i == 0), words * (i == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            rows = list(segment(now, held))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["p", "block", "seg", "levels", "tokens", "words"])

        for b in batches:
            for s, p, block, grams, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != now:
                    if held:
                        yield done()
                    now, held = s, []
                held.append((p, block, unpack_sorted(grams), counts))
        if held:
            yield done()
        release_memory()

    return asked.repartition(segments, "seg").sortWithinPartitions("seg").mapInArrow(run, _ANSWER)


def _segment_count(docs: DataFrame, order: int) -> int:
    chars = docs.select(F.sum(F.length("text")).alias("c")).first().c or 0
    return max(4, math.ceil(chars * order / 6 / SEGMENT_GRAMS))


def _store(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    path = fresh_path(df.sparkSession, name)
    write_table(df.repartition("p"), path, "p")
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def fit(docs: DataFrame, order: int = 3, base: float = 2.0) -> Model:
    """Count, quantise and store the n-grams of `docs`. The segment count follows the size of the text."""
    segments, path = _segment_count(docs, order), fresh_path(docs.sparkSession, "lmbloom")
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    asked = questions(text_blocks(docs.select("text", F.lit(0).alias("__key")), "__key"), order, segments)
    total = answers(asked, segments, base, store=path).agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).first()
    return Model(path, segments, order, base, total.t or 0, total.w or 0)


def _smoothed(levels: list[np.ndarray], base: float, tokens: int, vocabulary: int, mix: float) -> np.ndarray:
    """levels[0] is the word's own level; levels[2k-1], levels[2k] those of the (k+1)-gram and of its history."""
    stands = level_count(np.arange(256), base)
    p = (stands[levels[0]] + 1) / (tokens + vocabulary + 1)
    for k in range(1, len(levels), 2):
        full, history = stands[levels[k]], stands[levels[k + 1]]
        ml = np.minimum(1.0, full / np.maximum(history, 1e-9))
        p = np.where(history > 0, mix * ml + (1 - mix) * p, p)
    return np.log(p)


def _score_blocks(blocks: DataFrame, path: str, model: Model, key: str, kind: str, mix: float) -> DataFrame:
    order, base, tokens, vocabulary = model.order, model.base, model.tokens, model.vocabulary

    def load(p: int) -> dict[int, np.ndarray]:
        fs, root = pafs.FileSystem.from_uri(path)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/p={p}", allow_not_found=True)) if f.path.endswith(".parquet")]
        parts: dict[int, list] = {}
        for name in files:
            with fs.open_input_file(name) as f:
                got = pq.read_table(f, columns=["block", "seg", "levels"])
            for block, s, data in zip(*(got.column(c).to_pylist() for c in ("block", "seg", "levels")), strict=True):
                parts.setdefault(block, []).append((s, data))
        return parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {}
        for b in batches:
            for p, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if p != now:
                    now, parts = p, load(p)
                level = np.frombuffer(b"".join(zstandard.decompress(x) for _, x in sorted(parts.get(block, []))), np.uint8)
                slices = []
                for rows in _slices(data):
                    t = Tokens(rows.column("text"))
                    grams = position_grams(t, order)
                    own, back = np.unique(np.concatenate([g for _, g in grams]), return_inverse=True)
                    slices.append((rows.column(key), t.lengths, own, back.astype(np.int32)))
                u = slices[0][2] if len(slices) == 1 else _distinct([x[2] for x in slices])
                if len(u) != len(level):
                    raise RuntimeError(f"block {p}/{block} asked for {len(u)} grams and got {len(level)} levels")
                for keys, lengths, own, back in slices:
                    got, at, q, where = level[np.searchsorted(u, own)][back], 0, [], gram_ends(lengths, order)
                    for w in where:
                        full = np.zeros(len(where[0]), np.uint8)
                        full[w] = got[at : at + len(w)]
                        at += len(w)
                        q.append(full)
                    levels = [q[0]]
                    for n in range(1, order):
                        history = np.zeros_like(q[0])
                        history[where[n]] = q[n - 1][where[n] - 1]
                        levels += [q[n], history]
                    total = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=_smoothed(levels, base, tokens, vocabulary, mix), minlength=len(lengths))
                    empty = lengths == 0
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(lengths), pa.array(total, mask=empty), pa.array(total / np.maximum(lengths, 1), mask=empty)],
                        [key, "n_tokens", "log_prob", "mean_log_prob"],
                    )
                release_memory()

    return blocks.mapInArrow(run, f"`{key}` {kind}, n_tokens long, log_prob double, mean_log_prob double")


def score(docs: DataFrame, model: Model | None = None, key: str = "doc_id", order: int = 3, base: float = 2.0, mix: float = 0.7) -> DataFrame:
    """(key, n_tokens, log_prob, mean_log_prob) for each row of `docs`: under `model`, or, without one, under a model of `docs`
    themselves, whose segments answer in the pass that builds them."""
    blocks = text_blocks(docs, key)
    segments = model.segments if model else _segment_count(docs, order)
    path, got = _store(answers(questions(blocks, model.order if model else order, segments), segments, base, model=model), "lmlevels")
    if model is None:
        total = got.agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).first()
        model = Model(None, segments, order, base, total.t or 0, total.w or 0)
    return _score_blocks(blocks, path, model, key, docs.schema[key].dataType.simpleString(), mix)
