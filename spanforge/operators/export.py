"""Export adapters (family P): reshapes of evaluation and lifecycle results for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def evidence_metrics(results: DataFrame, regions: DataFrame) -> DataFrame:
    """Means of hits, over- and undercitation, and of the words in retrieved context."""
    words = regions.select(F.col("ref").alias("r"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("w"))
    per = results.select("query_id", F.explode("context").alias("r")).join(words, "r").groupBy("query_id").agg(F.greatest(F.lit(1), F.sum("w")).alias("support"))
    j = results.join(per, "query_id", "left")
    return j.agg(
        F.count("*").alias("n"),
        F.avg(F.col("hit_at_1").cast("double")).alias("hit_at_1"),
        F.avg("rr").alias("mrr"),
        F.avg(F.size(F.array_except("context", "gold_refs")).cast("double")).alias("avg_overcitation"),
        F.avg(F.size(F.array_except("gold_refs", "context")).cast("double")).alias("avg_undercitation"),
        F.avg(F.coalesce("support", F.lit(0)).cast("double")).alias("avg_support_tokens"),
    )


def qrels(gold: DataFrame, run_id: str = "run") -> DataFrame:
    """One relevance row per gold ref."""
    return gold.select(F.format_string("q%04d", F.col("query_id")).alias("query_id"), F.lit(run_id).alias("iteration"), F.col("ref").alias("document_id"), F.lit(1).cast("long").alias("relevance"))


def document_metadata(regions: DataFrame) -> DataFrame:
    """P5: (ref, doc_id, ordinal, hash, prev_ref, next_ref) of each region."""
    from .regions import linked, with_hash

    return linked(with_hash(regions)).select("ref", "doc_id", "ordinal", "hash", "prev_ref", "next_ref")


def trace_events(results: DataFrame, run: str = "run") -> DataFrame:
    """One event per example with a digest id."""
    return results.select(T.digest16(F.concat(F.lit(run + ":"), F.col("query_id").cast("string"))).alias("event_id"), "query_id", "hit_at_1", "hit_at_k", F.array_join("gold_refs", ",").alias("gold_refs"), F.coalesce("top_ref", F.lit("")).alias("top_ref"))


def answer_rows(results: DataFrame, regions: DataFrame) -> DataFrame:
    """Per example the digest of its contexts and of its references, texts joined in ref order."""
    text = regions.select(F.col("ref").alias("r"), "text")

    def side(column: str, name: str) -> DataFrame:
        rows = results.select("query_id", F.explode(column).alias("r")).join(text, "r")
        return rows.groupBy("query_id").agg(T.digest16(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n")).alias(name), F.count("*").alias("n_" + name))

    return results.select("query_id").join(side("context", "contexts"), "query_id", "left").join(side("gold_refs", "references"), "query_id", "left")


def tool_summary(results: DataFrame, regions: DataFrame, gold: DataFrame) -> DataFrame:
    """Sizes of corpus and suite with the headline metrics, as one row."""
    a = regions.agg(F.count("*").alias("regions"), F.countDistinct("doc_id").alias("documents"))
    g = gold.agg(F.countDistinct("query_id").alias("labelled"), F.countDistinct("ref").alias("gold_refs"))
    m = results.agg(F.count("*").alias("examples"), F.avg(F.col("hit_at_k").cast("double")).alias("hit_at_k"), F.avg("rr").alias("mrr"))
    return a.crossJoin(g).crossJoin(m)
