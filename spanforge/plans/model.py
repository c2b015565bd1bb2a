"""Model tables over the test data: regions, queries, gold labels, revisions and feedback events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, lifecycle, refs, regions, retrieval, scan

#: Invented text has none of the usual cue words, so its own frequent words stand in for them.
LEXICON = {"may": ["with "], "must": ["from "], "must_not": ["this "]}
PAIRS = [(["must"], ["may"]), (["may", "must"], ["must_not"])]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.line_regions(table(spark, d, "documents"), keep=["lang", "source"])


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Regions that hold a line of 20 characters or more of a benchmark item.

    A line of four words or more holds its second and third word between blanks, and so does a region with it: that pair is the key of an
    equi-join, and whole lines are compared for the few that share it. Only shorter lines, if there are any, are compared with all regions.
    """
    lines = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split("text", "\n", -1)).alias("l")).where(F.length("l") >= 20)
    lines = lines.select("query_id", "l", F.split("l", " ", -1).alias("w"))
    r = line_regions(spark, d).select("ref", "text")
    pair = lambda w, i: F.concat_ws(" ", w[i], w[i + 1])
    keyed = lines.where(F.size("w") >= 4).select("query_id", "l", pair(F.col("w"), 1).alias("key"))
    words = r.select("ref", "text", F.split("text", " ", -1).alias("w")).where(F.size("w") >= 4)
    pairs = words.select("ref", "text", F.explode(F.array_distinct(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda x, y: F.concat_ws(" ", x, y)))).alias("key"))
    found = pairs.join(scan.few(keyed, keyed.count()), "key").where(F.col("text").contains(F.col("l"))).select("query_id", "ref")
    short = lines.where(F.size("w") < 4)
    if not short.isEmpty():
        found = found.union(r.join(short, r["text"].contains(short["l"])).select("query_id", "ref"))
    return found.distinct()


def examples(spark: SparkSession, d: str) -> DataFrame:
    return queries(spark, d).select("query_id", F.when(F.length("query") < 150, "short").otherwise("long").alias("style"))


def hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return retrieval.search(line_regions(spark, d), queries(spark, d), k)


def results(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.evaluate(hits(spark, d), gold(spark, d), examples(spark, d))
    return r.withColumn("mode", F.when(F.col("n_gold") <= 1, "single").otherwise("distributed"))


def strategy_hits(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    """Hits of the named strategies, of all three without names. A search counts its terms when it is made, so only those wanted are."""
    r, q = line_regions(spark, d), queries(spark, d)
    made = {
        "flat": lambda: retrieval.search(r, q, 10),
        "hierarchical": lambda: retrieval.search_hierarchical(r, q, 5, 10).select("query_id", "rank", "ref", "score"),
        "reranked": lambda: retrieval.rerank(r, q, 30, 10),
    }
    return {name: made[name]() for name in names or made}


def strategies(spark: SparkSession, d: str) -> DataFrame:
    g, e = gold(spark, d), examples(spark, d)
    parts = [evaluation.summarize(evaluation.evaluate(h, g, e)).withColumn("strategy", F.lit(name)) for name, h in strategy_hits(spark, d).items()]
    return parts[0].union(parts[1]).union(parts[2])


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Per document a citation string over its own regions: a range and a single ref."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc"))
    text = F.format_string("[%s:P02-%s:P04, %s:p1]", "doc", "doc", "doc")
    return refs.parse_citations(docs.select(F.col("doc").alias("key"), text.alias("cite")), "cite")


def old(spark: SparkSession, d: str) -> DataFrame:
    return line_regions(spark, d).select(F.col("doc_id").alias("path"), "ref", "ordinal", "text")


def new(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.mutated(old(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    ref = lambda x: F.concat(F.lit("r"), x.cast("string"))
    return e.select(
        "event_id",
        "ts",
        F.concat(F.lit("Query  "), F.col("user_id").cast("string")).alias("query"),
        F.array(ref(k % 20)).alias("top_refs"),
        F.when(t.isin("click", "purchase"), ref(k * 7 % 20)).alias("clicked_ref"),
        F.when(t == "purchase", ref(k % 5)).alias("selected_ref"),
        F.when(t == "error", False).when(t == "purchase", True).alias("useful"),
        (t == "signup").alias("no_answer"),
    )


def headed(spark: SparkSession, d: str) -> DataFrame:
    """Regions with headings: every fourth one gets a mark of level 1 to 3."""
    r = line_regions(spark, d)
    o = F.col("ordinal") - 1
    mark = F.when(o % 4 == 0, F.concat(F.expr("repeat('#', cast(1 + ((ordinal - 1) div 4) % 3 as int))"), F.lit(" x "))).otherwise(F.lit(""))
    return r.withColumn("text", F.concat(mark, "text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")
