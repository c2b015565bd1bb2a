"""Retrieval evaluation (family E): ranked hits against gold refs, in group-bys over all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def evaluate(hits: DataFrame, gold: DataFrame, examples: DataFrame, k: int = 10) -> DataFrame:
    """One row per example of `examples` (query_id and any labels).

    `hits` has query_id, rank, ref, score and optionally context_refs (else a hit's context is itself); `gold` has query_id, ref.
    An empty gold set scores 0; ranks past k don't count.
    """
    if "context_refs" not in hits.columns:
        hits = hits.withColumn("context_refs", F.array("ref"))
    g = gold.groupBy("query_id").agg(F.sort_array(F.collect_set("ref")).alias("gold_refs"))
    h = hits.where(F.col("rank") <= k).join(g, "query_id", "left").withColumn("touch", F.coalesce(F.arrays_overlap("context_refs", "gold_refs"), F.lit(False)))
    per = h.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context_refs"))), lambda x: x["context_refs"]))).alias("context"),
        F.min(F.when(F.col("touch"), F.col("rank"))).alias("first_hit"),
        F.max(F.when(F.col("rank") == 1, F.col("ref"))).alias("top_ref"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
    )
    none = F.array().cast("array<string>")
    r = examples.join(g, "query_id", "left").join(per, "query_id", "left")
    r = r.withColumns({"gold_refs": F.coalesce("gold_refs", none), "context": F.coalesce("context", none)})
    both = F.size(F.array_intersect("context", "gold_refs"))
    # ranks are made on nine decimals, and so are margins: sums in another order give the same ones
    margin = F.round("top_score", 9) - F.round("second_score", 9)
    return r.withColumns(
        {
            "hit_at_1": F.coalesce(F.col("first_hit") == 1, F.lit(False)),
            "hit_at_k": both > 0,
            "rr": F.coalesce(1 / F.col("first_hit"), F.lit(0.0)),
            "coverage": F.when(F.size("gold_refs") > 0, both / F.size("gold_refs")).otherwise(0.0),
            "precision": F.when(F.size("context") > 0, both / F.size("context")).otherwise(0.0),
            "n_context": F.size("context").cast("long"),
            "n_gold": F.size("gold_refs").cast("long"),
            "margin": margin,
            "margin_ratio": F.round(margin / F.greatest(F.abs(F.round("top_score", 9)), F.lit(1e-9)), 9),
        }
    )


def _metrics() -> list:
    m = lambda c: F.avg(F.col(c).cast("double"))
    return [
        F.count("*").alias("n"),
        m("hit_at_1").alias("hit_at_1"),
        m("hit_at_k").alias("hit_at_k"),
        m("rr").alias("mrr"),
        m("coverage").alias("coverage"),
        m("precision").alias("precision"),
        m("n_context").alias("avg_context"),
    ]


def summarize(results: DataFrame, *by: str) -> DataFrame:
    """Means of the result columns, over all or by group."""
    return results.groupBy(*by).agg(*_metrics())


def by_style_and_mode(results: DataFrame) -> DataFrame:
    """Both groupings in one pass, by grouping sets."""
    return results.groupingSets([[F.col("style")], [F.col("mode")]], "style", "mode").agg(*_metrics())


def style_gap(results: DataFrame) -> DataFrame:
    """E5: per metric the largest difference between styles and the weakest style, ties by name."""
    s = summarize(results, "style")
    rows = s.select("style", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("hit_at_1", "hit_at_k", "mrr")])).alias("x")).select("style", "x.*")
    return rows.groupBy("metric").agg((F.max("v") - F.min("v")).alias("gap"), F.min(F.struct("v", "style"))["style"].alias("weakest"))


def heatmap(results: DataFrame) -> DataFrame:
    """Per gold ref its queries and misses, hardest first by (miss_at_k, hit rate, miss_at_1, ref)."""
    r = results.select(F.explode("gold_refs").alias("ref"), "hit_at_1", "hit_at_k")
    return r.groupBy("ref").agg(F.count("*").alias("n"), F.count_if(~F.col("hit_at_1")).alias("miss_at_1"), F.count_if(~F.col("hit_at_k")).alias("miss_at_k"))


def confusions(results: DataFrame) -> DataFrame:
    """(first gold ref, wrong top ref) with counts."""
    r = results.where((F.size("gold_refs") > 0) & F.col("top_ref").isNotNull() & ~F.array_contains("gold_refs", F.col("top_ref")))
    return r.groupBy(F.col("gold_refs")[0].alias("gold_ref"), "top_ref").agg(F.count("*").alias("n"))


def ordered_places(df: DataFrame, order: list[Column], buckets: int = 64) -> DataFrame:
    """`df` with `place` (from 0) in a total order and `total`, in two levels: rows go to ranges of the order, ranges are summed, and
    places are counted within a range. No task holds more than a range."""
    r = df.repartitionByRange(buckets, *order).withColumn("__range", F.spark_partition_id()).sortWithinPartitions(*order)
    r = r.withColumn("__in", F.monotonically_increasing_id() - F.shiftleft(F.col("__range").cast("long"), 33))
    n = r.groupBy("__range").agg(F.count("*").alias("__k"))
    n = n.select("__range", F.coalesce(F.sum("__k").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__k").over(W.partitionBy()).alias("total"))
    return r.join(F.broadcast(n), "__range").withColumn("place", F.col("__before") + F.col("__in")).drop("__range", "__in", "__before")


def quantile_thresholds(results: DataFrame, field: str = "margin_ratio", qs=(0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """0 and the nearest-rank quantiles, cut to 6 decimals so that the result they come from reaches them; index round((n - 1) q), half to even."""
    v = results.where(F.col(field).isNotNull() & F.col("top_ref").isNotNull()).groupBy(F.col(field).alias("x")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = v.select("x", (upto - F.col("k")).alias("lo"), upto.alias("hi"), F.sum("k").over(W.partitionBy()).alias("n"))
    at = [F.bround((F.col("n") - 1) * F.lit(q)).cast("long") for q in qs]
    picks = ranked.where(F.exists(F.array(*at), lambda i: (i >= F.col("lo")) & (i < F.col("hi"))))
    zero = results.sparkSession.createDataFrame([(0.0,)], "threshold double")
    return zero.union(picks.select((F.floor(F.col("x") * 1e6) / 1e6).alias("threshold"))).distinct()


def jump_curve(results: DataFrame, thresholds: DataFrame, field: str = "margin_ratio") -> DataFrame:
    """Per threshold how many results are accepted (field >= t), which share that is of all, and how good they are."""
    r = results.crossJoin(F.broadcast(thresholds)).withColumn("ok", F.coalesce((F.col(field) >= F.col("threshold")) & F.col("top_ref").isNotNull(), F.lit(False)))
    good = lambda c: F.coalesce(F.avg(F.when(F.col("ok"), F.col(c).cast("double"))), F.lit(0.0))
    return r.groupBy("threshold").agg(F.count_if("ok").alias("accepted"), F.avg(F.col("ok").cast("double")).alias("coverage"), good("hit_at_1").alias("precision_at_1"), good("hit_at_k").alias("hit_at_k"))


def best_strategy(summary: DataFrame, by: str = "strategy") -> DataFrame:
    """The summary rows with a rank by (hit@k, hit@1, MRR, coverage, precision, less context, name)."""
    order = [F.round(c, 9).desc() for c in ("hit_at_k", "hit_at_1", "mrr", "coverage", "precision")] + [F.round("avg_context", 9).asc(), F.col(by).asc()]
    return summary.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))


def deltas(summary: DataFrame, baseline: str, by: str = "strategy") -> DataFrame:
    """Differences of each run to the baseline at 6 decimals."""
    cols = ["hit_at_1", "hit_at_k", "mrr", "coverage", "precision", "avg_context"]
    base = summary.where(F.col(by) == baseline).select(*[F.col(c).alias("b_" + c) for c in cols])
    return summary.crossJoin(F.broadcast(base)).select(by, *[F.round(F.col(c) - F.col("b_" + c), 6).alias("d_" + c) for c in cols])


def ci_status(summary: DataFrame, minimum: dict[str, float], warn: float = 0.05) -> DataFrame:
    """Per metric pass, warn (up to `warn` below) or fail."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(v)).alias("minimum")) for m, v in minimum.items()]
    r = summary.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return r.withColumn("status", F.when(F.col("value") >= F.col("minimum"), "pass").when(F.col("value") >= F.col("minimum") - warn, "warn").otherwise("fail"))


def rank_summary(ranks: DataFrame, ks=(1, 3, 5, 10), rank: str = "first_hit") -> DataFrame:
    """Hit rate at several k and MRR at 4 decimals, in one pass."""
    k = F.col(rank)
    return ranks.agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(k <= x, F.lit(False)).cast("double")), 4).alias(f"hit_at_{x}") for x in ks], F.round(F.avg(F.coalesce(1 / k, F.lit(0.0))), 4).alias("mrr"))


def neighbour_rank(hits: DataFrame, gold: DataFrame, regions: DataFrame, widths=(0, 1, 2, 5)) -> DataFrame:
    """Per width, the first rank whose region lies within that many positions of a gold region of its document."""
    pos = regions.select("ref", "doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal")).alias("pos"))
    h = hits.join(pos, "ref").select("query_id", "rank", "doc_id", F.col("pos").alias("hp"))
    g = gold.join(pos, "ref").select("query_id", "doc_id", F.col("pos").alias("gp"))
    near = h.join(g, ["query_id", "doc_id"]).select("query_id", "rank", F.abs(F.col("hp") - F.col("gp")).alias("gap"))
    ws = F.explode(F.array(*[F.lit(w) for w in widths])).alias("width")
    best = near.select("query_id", "rank", "gap", ws).where("gap <= width").groupBy("width", "query_id").agg(F.min("rank").alias("first_hit"))
    every = gold.select("query_id").distinct().select("query_id", ws)
    return every.join(best, ["width", "query_id"], "left").groupBy("width").agg(F.count("*").alias("n"), F.avg(F.col("first_hit").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))).alias("mrr"))


def calibration(df: DataFrame, score: str, label: str, key: str, buckets: int = 10) -> DataFrame:
    """Equal buckets by score, with the mean score and the share of positives."""
    b = df.withColumn("bucket", F.ntile(buckets).over(W.orderBy(score, key)).cast("long"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.col(score).cast("double")).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rank-sum AUC with ties at half, from counts per distinct score: one shuffle by score, no pairs."""
    c = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    below = F.coalesce(F.sum("q").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = c.withColumn("w", F.col("p") * (below + F.col("q") / 2))
    return wins.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), (F.sum("w") / (F.sum("p") * F.sum("q"))).alias("auc"))


def split(df: DataFrame, key: str, block: str, eval_share: float = 0.3, seed: str = "split") -> DataFrame:
    """Per block the first share by digest order is "eval", at least one on each side where a block has two rows."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    w = W.partitionBy(block)
    r = df.withColumns({"pos": F.row_number().over(w.orderBy(h, key)), "size": F.count("*").over(w)})
    cut = F.when(F.col("size") < 2, 0).otherwise(F.least(F.col("size") - 1, F.greatest(F.lit(1), F.floor(F.col("size") * eval_share))))
    return r.withColumn("part", F.when(F.col("pos") <= cut, "eval").otherwise("train")).drop("pos", "size")


def even_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """N rows at evenly spread positions of an order (the first and the last among them)."""
    r = df.withColumns({"pos": F.row_number().over(W.orderBy(*order)) - 1, "size": F.count("*").over(W.partitionBy())})
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i * (F.col("size") - 1) / F.lit(max(1, n - 1))).cast("int"))
    return r.where((F.col("size") <= n) | F.array_contains(picks, F.col("pos"))).drop("pos", "size")
