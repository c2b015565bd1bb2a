"""Refs, citations and context (family R)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REF = r"(?:([^:\s,\[\]]+):)?([A-Za-z]\d+)"


def normal_id(ref: Column) -> Column:
    """R2: upper case; letter-and-number ids padded to two digits."""
    letter, number = F.upper(F.regexp_extract(ref, r"^([A-Za-z]+)\d+$", 1)), F.regexp_extract(ref, r"^[A-Za-z]+(\d+)$", 1)
    return F.when(number != "", F.concat(letter, F.format_string("%02d", number.cast("int")))).otherwise(F.upper(ref))


def parse_citations(df: DataFrame, column: str) -> DataFrame:
    """One row per cited ref or range of `column`: pos, doc, start_id, end_doc, end_id, is_range, ok.

    Brackets are dropped, commas split, `A-B` and `A..B` are inclusive ranges; a range across documents is not ok.
    """
    text = F.regexp_replace(column, r"[\[\]]", "")
    rows = df.select("*", F.posexplode(F.split(text, r"\s*,\s*")).alias("pos", "item")).where("trim(item) <> ''").withColumn("item", F.trim("item"))
    pattern = "^" + REF + r"(?:\s*(?:-|\.\.)\s*" + REF + ")?$"
    g = lambda k: F.regexp_extract("item", pattern, k)
    empty = lambda c: F.when(c == "", F.lit(None).cast("string")).otherwise(c)
    rows = rows.withColumns({"doc": empty(g(1)), "start_id": empty(g(2)), "end_doc": empty(g(3)), "end_id": empty(g(4))})
    rows = rows.withColumns({"start_id": normal_id(F.col("start_id")), "end_id": normal_id(F.coalesce("end_id", "start_id")), "is_range": F.col("end_id").isNotNull()})
    return rows.withColumns({"end_doc": F.coalesce("end_doc", "doc"), "ok": F.col("start_id").isNotNull() & (F.col("end_doc").isNull() | F.col("doc").isNull() | (F.col("end_doc") == F.col("doc")))})


def ref_string(doc: Column, start: Column, end: Column) -> Column:
    """The inverse of parse_citations."""
    head = F.concat(F.coalesce(F.concat(doc, F.lit(":")), F.lit("")), start)
    return F.when(start == end, head).otherwise(F.concat(head, F.lit("-"), end))


def expand_refs(citations: DataFrame, regions: DataFrame) -> DataFrame:
    """Refs of each citation, by ordinals within its document, ends in either order; unresolved ones give nothing.

    `citations` has doc, start_id, end_id; the two lookups and the range are equi-joins on the document with a band.
    """
    at = regions.select(F.col("doc_id").alias("doc"), F.col("region_id").alias("rid"), F.col("ordinal").alias("o"))
    c = citations.join(at.withColumnsRenamed({"rid": "start_id", "o": "o1"}), ["doc", "start_id"]).join(at.withColumnsRenamed({"rid": "end_id", "o": "o2"}), ["doc", "end_id"])
    r = regions.select(F.col("doc_id").alias("doc"), "ordinal", "ref")
    return c.join(r, "doc").where((F.col("ordinal") >= F.least("o1", "o2")) & (F.col("ordinal") <= F.greatest("o1", "o2")))


def validate_refs(refs: DataFrame, regions: DataFrame) -> DataFrame:
    """State of each `ref`: exact, bare (one document has that id), ambiguous (several have) or missing."""
    known = regions.select(F.col("ref").alias("known"))
    bare = regions.groupBy("region_id").agg(F.countDistinct("doc_id").alias("docs"), F.min("ref").alias("only"))
    r = refs.join(known, F.col("ref") == F.col("known"), "left").join(bare, normal_id(F.col("ref")) == F.col("region_id"), "left")
    state = F.when(F.col("known").isNotNull(), "exact").when(F.col("docs") == 1, "bare").when(F.col("docs") > 1, "ambiguous").otherwise("missing")
    return r.select(*refs.columns, state.alias("state"), F.coalesce("known", F.when(F.col("docs") == 1, F.col("only"))).alias("resolved"))


def expand_context(hits: DataFrame, regions: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Distinct refs around each (query, ref), by position within the document."""
    from pyspark.sql.window import Window as W

    pos = regions.select("doc_id", "ref", F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal")).alias("pos"))
    at = hits.select("query_id", "ref").join(pos, "ref").select("query_id", "doc_id", F.explode(F.sequence(F.col("pos") - before, F.col("pos") + after)).alias("pos")).distinct()
    return at.join(pos, ["doc_id", "pos"]).select("query_id", "doc_id", "pos", "ref")


def context_pack(context: DataFrame, regions: DataFrame) -> DataFrame:
    """Per query the regions' texts in document order under [ref] headers, with a word count of at least 1."""
    rows = context.join(regions.select("ref", "ordinal", "text"), "ref")
    item = F.struct("doc_id", "ordinal", F.concat(F.lit("["), F.col("ref"), F.lit("]\n"), F.col("text")).alias("t"))
    packed = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n").alias("text"), F.count("*").alias("n_refs"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return packed.withColumn("token_estimate", F.greatest(F.lit(1), words).cast("long"))


def score_sets(df: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """Precision, recall, F1, Jaccard, breadth and flags of predicted against gold ref arrays (both distinct).

    Two empty sides agree fully; one empty side scores 0.
    """
    p, g = F.size(predicted), F.size(gold)
    both = F.size(F.array_intersect(predicted, gold))
    none = (p == 0) & (g == 0)
    precision = F.when(none, 1.0).when(p == 0, 0.0).otherwise(both / p)
    recall = F.when(none, 1.0).when(g == 0, 0.0).otherwise(both / g)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return df.withColumns(
        {
            "overlap": both.cast("long"),
            "precision": precision,
            "recall": recall,
            "f1": f1,
            "jaccard": F.when(none, 1.0).otherwise(both / (p + g - both)),
            "breadth": F.when(none, 1.0).when(g == 0, p.cast("double")).otherwise(p / g),
            "exact": (both == p) & (both == g),
            "cover": both == g,
            "overcite": p > both,
            "undercite": g > both,
            "wrong": (both == 0) & ~none,
        }
    )


def citation_reward(scored: DataFrame) -> DataFrame:
    """0.55 F1 + 0.35 cover + 0.2 exact - 0.15 max(breadth - 1, 0) - 0.2 undercite, within 0 and 1; 0 where wrong."""
    num = lambda c: F.col(c).cast("double")
    raw = 0.55 * F.col("f1") + 0.35 * num("cover") + 0.2 * num("exact") - 0.15 * F.greatest(F.col("breadth") - 1, F.lit(0.0)) - 0.2 * num("undercite")
    return scored.withColumn("reward", F.when(F.col("wrong"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))))


def span_metrics(df: DataFrame) -> DataFrame:
    """Overlap, precision, recall, F1, IoU of [pred_start, pred_end) against [gold_start, gold_end)."""
    over = F.greatest(F.lit(0), F.least("pred_end", "gold_end") - F.greatest("pred_start", "gold_start"))
    p, g = F.col("pred_end") - F.col("pred_start"), F.col("gold_end") - F.col("gold_start")
    union = p + g - over
    precision, recall = F.when(p > 0, over / p).otherwise(0.0), F.when(g > 0, over / g).otherwise(0.0)
    return df.withColumns(
        {
            "overlap": over,
            "cover": over == g,
            "precision": precision,
            "recall": recall,
            "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0),
            "iou": F.when(union > 0, over / union).otherwise(0.0),
            "breadth": F.when(g > 0, p / g).otherwise(0.0),
        }
    )
