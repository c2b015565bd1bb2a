"""Region mapping and segmentation (family C): documents to addressable regions, all by explode, group and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def line_regions(docs: DataFrame, size: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Every `size` lines are a region; blank ones leave a gap in the numbering.

    One pass and no shuffle: the text is cut once, into lines or into runs of `size` lines. `keep` names further columns to carry along.
    """
    text = F.coalesce("text", F.lit(""))
    if size == 1:
        chunks = F.split(text, "\n", -1)
    else:
        runs = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(f"(?:[^\n]*\n){{1,{size}}}"), F.lit(0))
        chunks = F.transform(runs, lambda x: F.substring(x, F.lit(1), F.length(x) - 1))
    rows = docs.select("doc_id", *(keep or []), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("__n"), F.posexplode(chunks).alias("__i", "text")).where(F.col("text").rlike(r"\S"))
    number = F.col("__i") + 1
    return rows.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.format_string("P%02d", number).alias("region_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(":"), F.format_string("P%02d", number)).alias("ref"),
        number.cast("long").alias("ordinal"),
        (F.col("__i") * size + 1).cast("long").alias("start_line"),
        F.least(F.col("__i") * size + size, F.col("__n")).cast("long").alias("end_line"),
        "text",
        *(keep or []),
    )


def with_hash(regions: DataFrame) -> DataFrame:
    return regions.withColumn("hash", T.region_hash(F.col("text")))


def linked(regions: DataFrame, min_terms: int = 0) -> DataFrame:
    """Regions of at least `min_terms` distinct terms, with their neighbours after that filter."""
    if min_terms:
        regions = regions.where(F.size(T.align_terms(F.col("text"))) >= min_terms)
    w = W.partitionBy("doc_id").orderBy("ordinal")
    return regions.withColumns({"prev_ref": F.lag("ref").over(w), "next_ref": F.lead("ref").over(w)})


def word_windows(docs: DataFrame, size: int = 120, stride: int = 60) -> DataFrame:
    """C17: sliding windows of white-space words; the last one reaches the end."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    rows = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / stride)).cast("int")
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return rows.select(
        "doc_id",
        F.format_string("P%03d", F.col("i") + 1).alias("region_id"),
        (F.col("i") + 1).cast("long").alias("ordinal"),
        (F.col("i") * stride).cast("long").alias("start_word"),
        F.slice("w", F.col("i") * stride + 1, F.lit(size)).alias("words"),
    ).select("doc_id", "region_id", "ordinal", "start_word", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("text"))


def _nearest(level: Column, per_level: list[Column]) -> Column:
    """The entry of `per_level` (for levels 1 to 6) that belongs to `level`."""
    out = F.lit(None).cast("string")
    for k, c in enumerate(per_level, 1):
        out = F.when(level == k, c).otherwise(out)
    return out


def heading_parents(regions: DataFrame) -> DataFrame:
    """`level` of headings (0 for others) and the nearest open heading of a lower level as `parent_ref`."""
    regions = regions.withColumn("level", T.heading_level(F.col("text")).cast("long"))
    w = W.partitionBy("doc_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    below = [F.last(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("ref")), ignorenulls=True).over(w) for k in range(1, 8)]
    return regions.withColumn("parent_ref", F.when(F.col("level") == 0, below[6]).otherwise(_nearest(F.col("level"), below[:6])))


def section_map(regions: DataFrame) -> DataFrame:
    """C14: each heading's span, up to the next heading of its level or a lower one."""
    r = heading_parents(regions)
    w = W.partitionBy("doc_id").orderBy("ordinal")
    ahead = w.rowsBetween(1, W.unboundedFollowing)
    stops = [F.min(F.when((F.col("level") > 0) & (F.col("level") <= k), F.col("ordinal"))).over(ahead) for k in range(1, 7)]
    r = r.withColumns({"__stop": _nearest(F.col("level"), [s.cast("string") for s in stops]).cast("long"), "__pos": F.row_number().over(w), "__all": F.max("ordinal").over(W.partitionBy("doc_id"))})
    heads = r.where("level > 0").select("doc_id", F.col("ref").alias("heading_ref"), "level", "parent_ref", F.col("ordinal").alias("start"), "__stop", "__all")
    heads = heads.withColumn("__stop", F.coalesce("__stop", F.col("__all") + 1))
    inside = r.select(F.col("doc_id").alias("d2"), F.col("ordinal").alias("o2"), F.col("ref").alias("r2"))
    spans = heads.join(inside, (F.col("doc_id") == F.col("d2")) & (F.col("o2") >= F.col("start")) & (F.col("o2") < F.col("__stop")))
    return spans.groupBy("doc_id", "heading_ref", "level", "parent_ref").agg(F.max_by("r2", "o2").alias("end_ref"), F.count("*").alias("n_refs"))


def neighbour_units(regions: DataFrame, margin: int = 1) -> DataFrame:
    """Each region with its neighbours' refs, in document order."""
    w = W.partitionBy("doc_id").orderBy("ordinal").rowsBetween(-margin, margin)
    return regions.withColumn("context_refs", F.collect_list("ref").over(w))


def coarse_ranges(regions: DataFrame, n: int = 5) -> DataFrame:
    """C20: every n regions of a document are a range."""
    pos = F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal")) - 1
    r = regions.withColumn("range_no", F.floor(pos / n))
    return r.groupBy("doc_id", "range_no").agg(F.min_by("ref", "ordinal").alias("start_ref"), F.max_by("ref", "ordinal").alias("end_ref"), F.count("*").alias("n_refs"), F.sum(F.size(T.index_tokens(F.col("text")))).alias("tokens"))


def budget_prefix(regions: DataFrame, budget: int, by: str, order: list[str]) -> DataFrame:
    """Per `by`, the longest prefix within a token budget; the first region always stays."""
    w = W.partitionBy(by).orderBy(*order)
    t = regions.withColumn("tokens", F.size(T.index_tokens(F.col("text"))).cast("long"))
    t = t.withColumns({"used": F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), "pos": F.row_number().over(w).cast("long")})
    return t.where((F.col("used") <= budget) | (F.col("pos") == 1))


def target_shapes(regions: DataFrame) -> DataFrame:
    """Single, adjacent and (every fifth region) disjoint targets of each document."""
    w = W.partitionBy("doc_id").orderBy("ordinal")
    r = regions.select("doc_id", "ref", F.lead("ref", 1).over(w).alias("n1"), F.lead("ref", 3).over(w).alias("n3"), (F.row_number().over(w) - 1).alias("pos"))
    one = r.select("doc_id", F.lit("single").alias("shape"), F.col("ref").alias("gold_refs"))
    two = r.where("n1 is not null").select("doc_id", F.lit("adjacent").alias("shape"), F.concat_ws(",", "ref", "n1").alias("gold_refs"))
    apart = r.where("n3 is not null and pos % 5 = 0").select("doc_id", F.lit("disjoint").alias("shape"), F.concat_ws(",", "ref", "n3").alias("gold_refs"))
    return one.union(two).union(apart)


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """One region per HTML paragraph, tags taken out and blanks collapsed; empty ones are dropped."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)(?:</p>|<p>|</article>|$)"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(bodies).alias("i", "body"))
    clean = T.squeeze(F.regexp_replace("body", "<[^>]*>", " "))
    return rows.select("page_id", (F.col("i") + 1).cast("long").alias("ordinal"), clean.alias("text")).where("text <> ''")


def section_of(regions: DataFrame) -> DataFrame:
    """The first section (not the deepest) that holds each region, with regions before any heading left out."""
    r = heading_parents(regions)
    w = W.partitionBy("doc_id").orderBy("ordinal")
    # a heading starts an outermost section when no earlier open heading is of a lower or equal level: its level is a new minimum
    low = F.min(F.when(F.col("level") > 0, F.col("level"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    top = (F.col("level") > 0) & (low.isNull() | (F.col("level") <= low))
    r = r.withColumn("__top", F.when(top, F.col("ref")))
    return r.select("ref", F.last("__top", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("section_ref")).where("section_ref is not null")


def sliding_areas(docs: DataFrame, by: str, size: int = 10, stride: int = 5) -> DataFrame:
    """Membership of documents in overlapping areas of `size` documents every `stride`, in id order within `by`."""
    d = docs.select(by, "doc_id", (F.row_number().over(W.partitionBy(by).orderBy("doc_id")) - 1).cast("long").alias("pos"))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / stride)).cast("long")
    return d.select(by, "doc_id", F.explode(F.sequence(first, F.floor(F.col("pos") / stride).cast("long"))).alias("area"))


def distractors(regions: DataFrame, n: int = 2) -> DataFrame:
    """N prefixed copies of each region beside the region itself."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k")
    r = regions.select("doc_id", "region_id", "text", k)
    doc = F.when(F.col("k") == 0, F.col("doc_id")).otherwise(F.concat(F.lit("distractor"), F.col("k"), F.lit("_"), F.col("doc_id")))
    return r.select(F.concat(doc, F.lit(":"), "region_id").alias("ref"), "text")
