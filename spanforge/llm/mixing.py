"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by digest and cut into blocks of equal tokens. Slot i of the schedule takes the golden-ratio
point frac((i + 1) phi), in 48-bit fixed point, through the cumulative target weights to a source; slots are ranked
per source (in two levels) and the r-th takes the source's block r modulo its blocks (epoch r div its blocks). Unless a number of slots
is given, there are as many as it takes for each source to have all its blocks used once, so nothing is lost and weights are met by
repeating blocks. Given weights are kept as they are. Where none are given, the target of a source is the mean of its share of all blocks and of
its share of tokens^TEMPERATURE; it follows that the schedule has at most twice as many slots as there are blocks (with SPARE more a source).

Defined results: null or blank text has no tokens and travels with the block it falls into; rows of one source and doc_id (repeated
rows) are one document with their tokens added, and in `mix` all its rows travel together; a null source is a source of
its own, a null doc_id a document of its own; ties of the digest go by doc_id; an empty table gives an empty result; other
columns are ignored, and `mix` keeps the input's columns as they are. Given weights must name every source; a weight of exactly 0
leaves a source out, and a negative one, an unnamed source or a share too small for a slot of the fixed-point circle raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import free_name, materialize, sized

BLOCK_TOKENS = 8192
SEED = "mix-1"
#: Target weights are source tokens to this power, unless given.
TEMPERATURE = 0.7
POINT_BITS, PHI48 = 48, 173_961_102_589_771
#: Documents that one task of the prefix sum holds, about.
BUCKET_DOCS = 200_000
#: Slots that one task ranks, about.
RANK_SLOTS = 1 << 18
#: A source's slots may be this many fewer than its share, by the sequence's discrepancy.
SPARE = 2


def token_expr(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\f]+"), lambda x: x != "")).cast("long")


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """(source, doc_id, n_tokens, block, start): each document's block in its source's shuffled order."""
    ids = docs.select("source", "doc_id", token_expr(F.col("text")).alias("n"))
    ids = ids.groupBy("source", "doc_id").agg(F.sum("n").alias("n_tokens"))
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ids = materialize(ids.withColumn("h", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")), "mixids")
    # buckets of the digest's first bits, so that a large source is summed by many tasks
    bits = max(0, (ids.count() // BUCKET_DOCS).bit_length())
    ids = ids.withColumn("bucket", F.shiftright("h", 60 - bits))
    sums = ids.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), before.alias("before"), F.sum("s").over(W.partitionBy("source")).alias("total"))
    sums = sized(materialize(sums, "mixsums"), 60)
    ids = ids.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    inner = W.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.col("before") + F.sum("n_tokens").over(inner) - F.col("n_tokens")
    ids = ids.withColumn("start", start)
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(block_tokens))) - 1
    return ids.select("source", "doc_id", "n_tokens", F.least(F.expr(f"start div {int(block_tokens)}"), last).cast("long").alias("block"), "start", "h")


def targets(spark, held: DataFrame, weights: dict[str, float] | None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, n_blocks, tokens, w): integer weights of up to 38 digits. There is a row for each source, and sources are few."""
    per = held.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    per = per.withColumn("n_blocks", F.greatest(F.lit(1).cast("long"), F.expr(f"(tokens + {block_tokens - 1}) div {block_tokens}")))
    if weights is None:
        raw = F.greatest(F.lit(1), F.floor(F.pow(F.col("tokens").cast("double"), F.lit(TEMPERATURE)) * 100)).cast("long")
        per = materialize(per.withColumn("raw", raw), "mixweights")
        tot = per.agg(F.sum("raw").alias("r"), F.sum(F.col("n_blocks") + SPARE).alias("q")).first()
        whole = f"cast(raw * cast({tot.q or 1} as decimal(19,0)) + (n_blocks + {SPARE}) * cast({tot.r or 1} as decimal(19,0)) as decimal(38,0))"
        return per.withColumn("w", F.expr(whole)).drop("raw")
    if any(not v >= 0 for v in weights.values()):
        raise ValueError("weights must not be negative")
    total = sum(weights.values())
    given = {k: int(v / total * 10**15) if total else 0 for k, v in weights.items()}
    if lost := [k for k, v in weights.items() if v > 0 and given[k] < 1000]:
        raise ValueError(f"the shares of {lost} are too small")
    rows = spark.createDataFrame(list(given.items()), "s3 string, w long")
    both = materialize(per.join(rows, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3"), "mixgiven")
    if missing := [r.source for r in both.where("w is null").select("source").limit(20).collect()]:
        raise ValueError(f"no weights are given for the sources {missing}")
    return both.where("w > 0").withColumn("w", F.col("w").cast("decimal(38,0)"))


def ranked(hit: DataFrame) -> DataFrame:
    """`hit` with `r`, a slot's place among its source's, by counts of ranges of slots and then within each."""
    hit = hit.withColumn("range", F.expr(f"slot div {RANK_SLOTS}"))
    counts = hit.groupBy("source", "range").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("s5"), F.col("range").alias("r5"), before.alias("before"))
    inner = F.row_number().over(W.partitionBy("source", "range").orderBy("slot")) - 1
    return hit.withColumn("inner", inner).join(counts, F.col("source").eqNullSafe(F.col("s5")) & (F.col("range") == F.col("r5"))).withColumn("r", F.col("before") + F.col("inner"))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, slots: int | None = None, seed: str = SEED) -> DataFrame:
    """(slot, source, epoch, block, doc_id, n_tokens, offset): every document of every slot's block."""
    spark = docs.sparkSession
    held = materialize(blocks(docs, block_tokens, seed), "mixblocks")
    goal = materialize(targets(spark, held, weights, block_tokens), "mixgoal").collect()
    whole, bits = sum(int(r.w) for r in goal), 1 << POINT_BITS
    if slots is None:
        slots = max((-(-(r.n_blocks + SPARE) * whole // int(r.w)) for r in goal), default=0)
    # a source's interval of the points, cut at cells of their first ten bits: an equi-join, then the interval itself
    spans, upto, shift = [], 0, POINT_BITS - 10
    for r in sorted(goal, key=lambda r: (r.source is not None, r.source)):
        lo, hi = upto * bits // whole, (upto + int(r.w)) * bits // whole
        upto += int(r.w)
        if hi <= lo:
            raise ValueError(f"the share of {r.source!r} is too small")
        spans += [(r.source, r.n_blocks, lo, hi, cell) for cell in range(lo >> shift, ((hi - 1) >> shift) + 1)]
    cut = spark.createDataFrame(spans, "source string, n_blocks long, lo long, hi long, cell long")
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"cast(pmod(cast(id + 1 as decimal(20,0)) * {PHI48}, {bits}) as long)").alias("u")).withColumn("cell", F.shiftright("u", shift))
    hit = points.join(sized(materialize(cut, "mixspans"), 80), "cell").where("u >= lo and u < hi")
    plan = ranked(hit).select("slot", F.col("source").alias("s4"), F.expr("r div n_blocks").alias("epoch"), F.expr("r % n_blocks").cast("long").alias("b4"))
    out = held.join(sized(materialize(plan, "mixplan"), 60), F.col("source").eqNullSafe(F.col("s4")) & (F.col("block") == F.col("b4")))
    return out.select("slot", "source", "epoch", "block", "doc_id", "n_tokens", (F.col("start") - F.col("block") * block_tokens).alias("offset"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, slots: int | None = None) -> DataFrame:
    """The rows of `docs` as often and in the order that the schedule has them."""
    plan = materialize(schedule(docs, weights, block_tokens, slots), "mixschedule")
    slot, source, doc = (free_name(docs, x) for x in ("slot", "source", "doc"))
    plan = plan.select(F.col("slot").alias(slot), F.col("offset").alias(slot + "o"), F.col("source").alias(source), F.col("doc_id").alias(doc))
    out = docs.join(sized(plan, 80), docs["source"].eqNullSafe(plan[source]) & docs["doc_id"].eqNullSafe(plan[doc]))
    return out.repartitionByRange(F.col(slot)).sortWithinPartitions(slot, slot + "o", doc).select(*[F.col(f"`{c}`") for c in docs.columns])
