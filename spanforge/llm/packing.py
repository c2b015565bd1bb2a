"""Best-fit packing by linear grouping.

Documents (cut into pieces of at most a sequence) are large if longer than SMALL of the sequence. Large lengths are split in GROUPS
groups of equal cardinality, each rounded up to its longest; configurations of these few sizes are optimised by column
generation, documents replace the sizes, and small ones go, longest first, to the fullest sequence that still holds them.

All decisions depend on how many pieces there are of each length, a table of at most one row a token of the sequence;
the driver plans on that table and never sees documents. A piece is known by its length and its rank among equals; the plan maps
rank ranges to sequence ranges, and pieces meet it in a join.

Defined results: null or blank text has no tokens and no place (sequence, offset null); text is packed whole, longer than a
sequence in several pieces; repeated rows (also of one doc_id) are packed each on its own; ties of a length go by doc_id and then by
piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize
from .mixing import token_expr

CAPACITY, GROUPS, SMALL = 2048, 12, 1 / 8
#: Pieces that one task ranks, about.
RANK_ROWS = 200_000


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over the few sizes: the configuration of the highest value."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        v = best[c - sizes[fits]] + values[fits]
        k = int(np.argmax(v))
        if v[k] > best[c - 1] + 1e-12:
            best[c], took[c] = v[k], fits[k]
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, times) that cover the demand: column generation, rounded down, the rest by first-fit decreasing."""
    s, d = np.array(sizes, np.int64), np.array(demand, np.int64)
    k = len(s)
    if not k:
        return []
    columns = [np.eye(k, dtype=np.int64)[i] * (capacity // s[i]) for i in range(k)]
    basis = np.array(columns, float).T
    x = np.linalg.solve(basis, d)
    for _ in range(40 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, pattern = _best_pattern(s, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(direction > 1e-9, x / np.maximum(direction, 1e-9), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        x = np.maximum(np.linalg.solve(basis, d.astype(float)), 0)
    plan, left = [], d.copy()
    for j in range(k):
        times = int(math.floor(x[j] + 1e-7))
        pattern = basis[:, j].round().astype(np.int64)
        used = pattern > 0
        times = min([times, *(left[used] // pattern[used]).tolist()]) if used.any() else 0
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    # what rounding leaves is packed greedily, many equal sequences at once
    while left.any():
        pattern, room = np.zeros(k, np.int64), capacity
        for i in np.argsort(-s, kind="stable"):
            n = int(min(left[i], room // s[i]))
            pattern[i], room = n, room - n * int(s[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


class _Ranges:
    """Consecutive numbers handed out from the front, as ranges."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.ranges = ranges[::-1]

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n:
            start, size = self.ranges.pop()
            m = min(n, size)
            out.append((start, m))
            if size > m:
                self.ranges.append((start + m, size - m))
            n -= m
        return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): pieces of a length with these ranks go to consecutive sequences, all at one offset."""
    out: list[tuple[int, int, int, int, int]] = []
    used = {length: 0 for length in histogram}
    large = sorted((x for x in histogram if x > small * capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    # groups of equal cardinality over the sorted lengths; a length may be shared by two groups
    members: list[list[list[int]]] = []
    sizes: list[int] = []
    per = max(1, -(-total // groups)) if total else 1
    room = 0
    for length in large:
        n = histogram[length]
        while n:
            if not room:
                members.append([])
                sizes.append(length)
                room = per
            m = min(n, room)
            members[-1].append([length, m])
            n, room = n - m, room - m
    demand = [sum(m for _, m in g) for g in members]
    # two groups may round up to one size
    merged: dict[int, int] = {}
    for size, g in zip(sizes, members, strict=True):
        merged.setdefault(size, len(merged))
    order = list(merged)
    stock: list[list[list[int]]] = [[] for _ in order]
    need = [0] * len(order)
    for size, g, n in zip(sizes, members, demand, strict=True):
        stock[merged[size]] += g
        need[merged[size]] += n
    sequence = 0
    residual: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for pattern, times in configurations(order, need, capacity):
        slots = [i for i in range(len(order)) for _ in range(int(pattern[i]))]
        # substitute: runs over which every slot takes one actual length
        at = sequence
        left = times
        while left:
            heads, take = [], left
            want: dict[int, int] = defaultdict(int)
            for i in slots:
                want[i] += 1
            for i, n in want.items():
                length, count = stock[i][0]
                if count >= n:
                    take = min(take, count // n)
                else:
                    take = 1
            offset = 0
            for i in slots:
                run = take
                # with take 1 a size's slots may use several lengths
                length, count = stock[i][0]
                run = min(take, count)
                assert run == take
                heads.append((length, used[length], take, at, offset))
                used[length] += take
                stock[i][0][1] -= take
                if not stock[i][0][1]:
                    stock[i].pop(0)
                offset += length
            out += heads
            residual[capacity - offset].append((at, take))
            at, left = at + take, left - take
        sequence += times
    # best fit of the small ones, longest first: fullest sequence that has room
    spaces = {r: _Ranges(v) for r, v in residual.items() if r}
    heap = sorted(spaces)
    free = {r: sum(n for _, n in v.ranges) for r, v in spaces.items()}
    rooms: list[int] = heap
    for length in sorted((x for x in histogram if 0 < x <= small * capacity), reverse=True):
        n = histogram[length]
        while n:
            k = np.searchsorted(rooms, length)
            if k == len(rooms):
                fresh = min(n, -(-n // (capacity // length)))
                spaces.setdefault(capacity, _Ranges([])).ranges.insert(0, (sequence, fresh))
                free[capacity] = free.get(capacity, 0) + fresh
                sequence += fresh
                if capacity not in rooms:
                    rooms.insert(int(np.searchsorted(rooms, capacity)), capacity)
                continue
            r = rooms[k]
            m = min(n, free[r])
            for start, size in spaces[r].take(m):
                out.append((length, used[length], size, start, capacity - r))
                used[length] += size
                if r > length:
                    spaces.setdefault(r - length, _Ranges([])).ranges.append((start, size))
            free[r] -= m
            if not free[r]:
                rooms.pop(k)
                del free[r], spaces[r]
            if r > length:
                if r - length not in free:
                    rooms.insert(int(np.searchsorted(rooms, r - length)), r - length)
                free[r - length] = free.get(r - length, 0) + m
            n -= m
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, length): documents cut at the sequence's length; an empty one is a piece of length 0."""
    n = docs.select("doc_id", token_expr(F.col("text")).alias("n"))
    cut = n.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}")))))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """(doc_id, piece, length, sequence, offset) for every piece of every row."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_sequences(histogram, capacity, groups, small)
    # ranks within a length, in buckets of the key so that one length is ranked by many tasks
    buckets = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("length").alias("l2"), F.col("bucket").alias("b2"), before.alias("before"))
    inner = F.row_number().over(W.partitionBy("length", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "piece"))
    ranked = keyed.withColumn("r", inner - 1).join(sums, (F.col("length") == F.col("l2")) & (F.col("bucket") == F.col("b2")))
    ranked = ranked.select("doc_id", "piece", "length", (F.col("r") + F.col("before")).alias("rank"))
    # each range is cut at multiples of `cell` ranks, for an equi-join; ranges of one length don't overlap
    cell = max(1, sum(histogram.values()) // max(1, 4 * len(plan)))
    table = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], "l3 long, first long, count long, seq0 long, offset long").where("l3 >= 0")
    table = table.withColumn("cell", F.explode(F.sequence(F.expr(f"first div {cell}"), F.expr(f"(first + count - 1) div {cell}"))))
    joined = ranked.withColumn("c2", F.expr(f"rank div {cell}")).join(
        F.broadcast(table), (F.col("length") == F.col("l3")) & (F.col("c2") == F.col("cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count")), "left"
    )
    return joined.select("doc_id", "piece", "length", (F.col("seq0") + F.col("rank") - F.col("first")).alias("sequence"), "offset")
