"""Corpus discovery (family V): terms, roles, ranges, clusters and question plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.chunkers import safe_windows

#: Starts with a letter, hyphen compounds stay whole.
TOKEN = r"[\p{L}][\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)*"
ABBREVIATION = r"^[A-Z][A-Z0-9-]{2,}$"
GENERIC = sorted(set(T.KEYWORD_STOP) | set(T.SMELL_STOP) | {"code", "data", "each", "example", "find", "how", "must", "shall", "should", "such", "they", "under", "would"})
MENU = ["english", "français", "tagalog", "العربية", "简体", "繁体", "한국어"]


def tokens(text: Column) -> Column:
    """Candidate discovery terms in order."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(raw, lambda t: (F.length(t) > 3) & ~t.rlike(r"[0-9]") & ~t.isin(GENERIC) & ~t.rlike(r"^[a-z]+-[a-z]+-[a-z0-9-]+$"))


def abbreviations(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), lambda t: t.rlike(ABBREVIATION))


def roles(regions: DataFrame) -> DataFrame:
    """Roles of each region; "content" where nothing else fits."""
    text = F.trim(F.col("text"))
    low = F.lower(text)
    any_of = lambda *ws: [low.contains(w) for w in ws]

    def either(cs):
        out = F.lit(False)
        for c in cs:
            out = out | c
        return out

    words = F.size(F.split(text, r"\s+"))
    short = ~text.contains("\n") & (words <= 10) & ~text.rlike(r"[.;:]$") & ~low.contains(" means ")
    found = F.array_compact(
        F.array(
            F.when(T.is_magnet(F.concat_ws(" ", "doc_id", F.substring("text", 1, 240))), "query_magnet"),
            F.when(text.startswith("#") | short, "heading"),
            F.when(low.contains("table of contents") | low.startswith("contents"), "navigation_only"),
            F.when((F.size(abbreviations(text)) >= 8) | (sum((low.contains(m).cast("int") for m in MENU), F.lit(0)) >= 5), "boilerplate"),
            F.when(low.contains(" means ") | low.endswith(" means"), "definition"),
            F.when(either(any_of("shall", "must", "required", "requirement")), "obligation"),
            F.when(either(any_of("except", "unless", "exempt")), "exception"),
            F.when(either(any_of("for example", "e.g.", "example")), "example"),
        )
    )
    return regions.withColumn("roles", F.when(F.size(found) == 0, F.array(F.lit("content"))).otherwise(found))


def top_terms(regions: DataFrame, extract=tokens, n: int = 40, refs: int = 12) -> DataFrame:
    """V2: the n most frequent terms with up to `refs` refs in order; ties by first place (document, ordinal, position)."""
    t = regions.select("ref", "doc_id", "ordinal", F.posexplode(extract(F.col("text"))).alias("pos", "term"))
    per = t.groupBy("term", "ref").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "ordinal", "pos")).alias("first"))
    g = per.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("df"), F.min("first").alias("first"))
    top = g.withColumn("rank", F.row_number().over(W.orderBy(F.col("n").desc(), "first")).cast("long")).where(F.col("rank") <= n)
    some = per.join(F.broadcast(top.select("term")), "term").withColumn("r", F.row_number().over(W.partitionBy("term").orderBy("ref"))).where(F.col("r") <= refs)
    some = some.groupBy("term").agg(F.array_join(F.sort_array(F.collect_list("ref")), ",").alias("refs"))
    return top.join(some, "term").select("rank", "term", "n", "df", "refs")


def range_candidates(regions: DataFrame, shared: int = 2) -> DataFrame:
    """V2: neighbouring regions of a document that share terms."""
    r = regions.select("doc_id", "ref", "ordinal", F.array_distinct(tokens(F.col("text"))).alias("t"))
    w = W.partitionBy("doc_id").orderBy("ordinal")
    r = r.withColumns({"next_ref": F.lead("ref").over(w), "nt": F.lead("t").over(w)})
    return r.where("next_ref is not null").withColumn("shared", F.size(F.array_intersect("t", "nt")).cast("long")).where(F.col("shared") >= shared).select("ref", "next_ref", "shared")


def doc_clusters(regions: DataFrame, terms: int = 12) -> DataFrame:
    """V5: one cluster per document with its most frequent terms, ties by first place."""
    t = regions.select("doc_id", "ordinal", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    c = t.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "pos")).alias("first"))
    w = W.partitionBy("doc_id").orderBy(F.col("n").desc(), "first")
    c = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= terms)
    c = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ",").alias("terms"))
    sizes = regions.groupBy("doc_id").agg(F.count("*").alias("regions"), F.sum(T.approx_tokens(F.col("text"))).alias("tokens"))
    return sizes.join(c, "doc_id", "left").withColumn("terms", F.coalesce("terms", F.lit("")))


def tree_clusters(regions: DataFrame, top: str, child: str) -> DataFrame:
    """V6: sizes of a two-level hierarchy, by rollup."""
    r = regions.rollup(top, child).agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("regions"), F.sum(T.approx_tokens(F.col("text"))).alias("tokens"), F.grouping_id().cast("long").alias("level"))
    return r


def tag_graph(regions: DataFrame, target: int = 40) -> DataFrame:
    """V7, V9: each region goes to its strongest selected term; small buckets and the rest go to "other".

    Terms count within the document-frequency band [2 (1 under 20 regions), max(2, 16 %)].
    """
    sets = regions.select("ref", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    total = regions.agg(F.count("*").alias("total"))
    df = sets.groupBy("term").agg(F.count("*").alias("df")).crossJoin(total)
    low = F.when(F.col("total") < 20, 1).otherwise(2)
    df = df.where((F.col("df") >= low) & (F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("total") * 0.16))) & (F.col("df") >= 2))
    chosen = df.withColumn("r", F.row_number().over(W.orderBy(F.col("df").desc(), "term"))).where(F.col("r") <= 2 * target).select("term", "df")
    best = sets.join(F.broadcast(chosen), "term").groupBy("ref").agg(F.min(F.struct(-F.col("df"), F.col("term")))["term"].alias("tag"))
    tagged = regions.select("ref").join(best, "ref", "left")
    size = tagged.groupBy("tag").agg(F.count("*").alias("n")).crossJoin(total)
    keep = size.where("tag is not null").where(F.col("n") >= F.greatest(F.lit(2), F.expr(f"total div {3 * target}")))
    keep = keep.withColumn("r", F.row_number().over(W.orderBy(F.col("n").desc(), "tag"))).where(F.col("r") < target)
    names = tagged.join(F.broadcast(keep.select("tag", F.lit(1).alias("kept"))), "tag", "left")
    return names.select("ref", F.when(F.col("kept") == 1, F.concat(F.lit("tag:"), "tag")).otherwise("tag:other").alias("cluster"))


def balanced_clusters(regions: DataFrame, target: int = 12, group: str | None = None) -> DataFrame:
    """V8: diverse seeds (cosine under .72) and capacity-greedy assignment; order-dependent, so one task per group does it whole."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ref")
        bags = [pd.Series(list(t)).value_counts() if len(t) else pd.Series(dtype=int) for t in frame.t]

        def cos(a, b):
            both = a.index.intersection(b.index)
            n = (a**2).sum() ** 0.5 * (b**2).sum() ** 0.5
            return float((a[both] * b[both]).sum() / n) if n else 0.0

        order = sorted(range(len(bags)), key=lambda i: (-len(bags[i]), i))
        seeds: list[int] = []
        for i in order:
            if len(seeds) < target and all(cos(bags[i], bags[s]) < 0.72 for s in seeds):
                seeds.append(i)
        room = {s: -(-len(bags) // max(1, len(seeds))) for s in seeds}
        out = []
        for i in range(len(bags)):
            best = max((s for s in seeds if room[s] > 0), key=lambda s: (cos(bags[i], bags[s]), -s))
            room[best] -= 1
            out.append(frame.ref.iloc[best])
        return pd.DataFrame({"ref": frame.ref.to_numpy(), "seed_ref": out})

    r = regions.select("ref", tokens(F.col("text")).alias("t"), (F.col(group) if group else F.lit("all")).alias("g"))
    return r.groupBy("g").applyInPandas(run, "ref string, seed_ref string")


def windows(regions: DataFrame, budget: int = 2000, overlap: int = 1) -> DataFrame:
    """Per document windows of whole regions within a token budget: (doc_id, window, first_ref, last_ref, tokens)."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        n = frame.tokens.tolist()
        spans = safe_windows(n, budget, overlap)
        return pd.DataFrame({"doc_id": key[0], "window": range(1, len(spans) + 1), "first_ref": [frame.ref.iloc[a] for a, _ in spans], "last_ref": [frame.ref.iloc[b - 1] for _, b in spans], "tokens": [sum(n[a:b]) for a, b in spans]})

    r = regions.select("doc_id", "ref", "ordinal", T.approx_tokens(F.col("text")).alias("tokens"))
    return r.groupBy("doc_id").applyInPandas(run, "doc_id string, window long, first_ref string, last_ref string, tokens long")


def windowed_terms(regions: DataFrame, per: int = 50, n: int = 40) -> DataFrame:
    """V4: term counts per window of regions, merged by term: partial and final aggregation."""
    r = regions.withColumn("win", F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal")) - 1) / per))
    part = r.select("doc_id", "win", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "win", "term").agg(F.count("*").alias("c"))
    g = part.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("windows"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.col("n").desc(), "term")).cast("long")).where(F.col("rank") <= n)


def question_plan(regions_with_roles: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """Region x style rows; navigation and boilerplate get direct questions alone, excluded regions none."""
    styles = regions_with_roles.sparkSession.createDataFrame(list((counts or {"adversarial": 1, "concern": 1, "direct": 1}).items()), "style string, n long")
    r = regions_with_roles.where(~F.array_contains("roles", "query_magnet"))
    direct = F.arrays_overlap("roles", F.array(F.lit("navigation_only"), F.lit("boilerplate")))
    rows = r.select("ref", direct.alias("direct_only")).crossJoin(F.broadcast(styles)).where((F.col("n") > 0) & (~F.col("direct_only") | (F.col("style") == "direct")))
    return rows.select("ref", "style", "n")


def local_questions(plan: DataFrame, topics: DataFrame) -> DataFrame:
    """Template questions by style on a region's topic."""
    r = plan.join(topics, "ref")
    q = (
        F.when(F.col("style") == "direct", F.concat(F.lit("What does this section explain about "), "topic", F.lit("?")))
        .when(F.col("style") == "concern", F.concat(F.lit("Where should I look if I have a practical problem involving "), "topic", F.lit("?")))
        .otherwise(F.lit("Which part covers the rule or behaviour behind this topic?"))
    )
    return r.select("ref", "style", q.alias("query"))


def sample(regions: DataFrame, n: int, seed: str = "sample") -> DataFrame:
    """N non-heading regions by digest order."""
    r = regions.where(T.heading_level(F.col("text")) == 0)
    return r.orderBy(F.md5(F.concat(F.lit(seed), "ref")), "ref").limit(n)


def review(regions: DataFrame, clusters: DataFrame, plan: DataFrame) -> DataFrame:
    """Issues of a discovery: regions in no cluster, regions without planned questions, oversized and one-region clusters."""
    per = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    total = regions.agg(F.count("*").alias("total"))
    parts = [
        regions.join(clusters, "ref", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unclustered_region").alias("issue"), "n"),
        regions.join(plan, "ref", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unplanned_region").alias("issue"), "n"),
        per.where("n = 1").agg(F.count("*").alias("n")).select(F.lit("single_region_cluster").alias("issue"), "n"),
        per.crossJoin(total).where(F.col("n") > F.col("total") * 0.5).agg(F.count("*").alias("n")).select(F.lit("dominant_cluster").alias("issue"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
