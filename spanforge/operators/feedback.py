"""Search feedback (family F): events to clusters per normalised query and to review actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

PRIORITY = {
    "add_shadow_alias_or_doc2query": 0,
    "record_confusion_pair": 1,
    "review_query_magnet": 2,
    "review_no_answer_or_missing_coverage": 3,
    "review_ambiguous_query": 4,
    "review_missing_refs": 5,
}


def with_target(events: DataFrame) -> DataFrame:
    """the selected ref, else the clicked one unless `useful` is false."""
    clicked = F.when(F.coalesce(F.col("useful"), F.lit(True)), F.col("clicked_ref"))
    return events.withColumn("target_ref", F.coalesce("selected_ref", clicked))


def _counted(e: DataFrame, column: str, name: str) -> DataFrame:
    """Per query the refs of a column by falling count, ties by first event."""
    c = e.where(F.col(column).isNotNull()).groupBy("query", column).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    w = W.partitionBy("query").orderBy(F.col("n").desc(), "first")
    c = c.withColumn("pos", F.row_number().over(w))
    first = lambda x: F.max(F.when(F.col("pos") == 1, F.col(x)))
    return c.groupBy("query").agg(first(column).alias(name), first("n").alias(name + "_n"), F.count("*").alias(name + "_kinds"), F.collect_set(column).alias(name + "_all"))


def clusters(events: DataFrame, known_refs: DataFrame | None = None, min_count: int = 2) -> DataFrame:
    """per normalised query counts, the dominant top ref and target ref, and refs that the corpus lacks."""
    e = with_target(events.withColumn("query", T.query_key(F.col("query")))).withColumn("top_ref", F.try_element_at("top_refs", F.lit(1)))
    base = e.groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("no_answer")).alias("no_answer"), F.count_if(~F.coalesce(F.col("useful"), F.lit(True))).alias("negative")).where(F.col("n") >= min_count)
    out = base.join(_counted(e, "top_ref", "top"), "query", "left").join(_counted(e, "target_ref", "target"), "query", "left")
    if known_refs is None:
        return out.withColumn("missing", F.lit(0).cast("long"))
    used = e.select("query", F.col("top_ref").alias("ref")).union(e.select("query", "target_ref")).where("ref is not null").distinct()
    lost = used.join(known_refs.select("ref").distinct(), "ref", "left_anti").groupBy("query").agg(F.count("*").alias("missing"))
    return out.join(lost, "query", "left").withColumn("missing", F.coalesce("missing", F.lit(0).cast("long")))


def actions(cl: DataFrame) -> DataFrame:
    """(query, action) rows by rule; a cluster that meets none is tracked."""
    target, top, n = F.col("target"), F.col("top"), F.col("n")
    half = F.greatest(F.lit(2), F.expr("n div 2"))
    differs = target.isNotNull() & (top.isNull() | (target != top))
    rules = [
        F.when(F.col("missing") > 0, "review_missing_refs"),
        F.when(differs, "add_shadow_alias_or_doc2query"),
        F.when(differs & top.isNotNull(), "record_confusion_pair"),
        F.when(top.isNotNull() & (F.col("negative") >= half) & target.isNull(), "review_query_magnet"),
        F.when(F.col("no_answer") >= half, "review_no_answer_or_missing_coverage"),
        F.when(F.coalesce("target_kinds", F.lit(0)) >= 2, "review_ambiguous_query"),
    ]
    found = F.array_compact(F.array(*rules))
    found = F.when(F.size(found) == 0, F.array(F.lit("track_feedback_cluster"))).otherwise(found)
    return cl.select("query", n, F.explode(found).alias("action"))


def priority(action):
    out = F.lit(9)
    for name, p in PRIORITY.items():
        out = F.when(action == name, p).otherwise(out)
    return out


def ordered(cl: DataFrame, top_n: int = 25) -> DataFrame:
    """clusters by their best action, count and query; the report's length is `top_n`."""
    best = actions(cl).groupBy("query", "n").agg(F.min(priority(F.col("action"))).cast("long").alias("best"))
    return best.orderBy("best", F.col("n").desc(), "query").limit(top_n)
