"""Label lifecycle over corpus revisions (family L).

Regions are (path, ref, ordinal, text); refs are unique within a revision. The expensive comparisons see only what the
exact joins before them left over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

FUZZY, SPLIT, LAYERED = 0.82, 0.82, 0.95


def prepared(regions: DataFrame) -> DataFrame:
    return regions.select("path", "ref", "ordinal", "text", T.fingerprint(F.col("text")).alias("fp"), F.array_distinct(T.ascii_words(F.col("text"))).alias("tok"), T.quote(F.col("text")).alias("quote"), T.quote(F.col("text"), 8).alias("quote8"))


def mutated(regions: DataFrame) -> DataFrame:
    """A deterministic next revision: by number, regions are deleted, reworded, moved to another path or split; ordinals are given anew."""
    key = F.pmod(F.regexp_extract("path", r"(\d+)", 1).cast("long") * 31 + F.col("ordinal"), F.lit(10))
    r = regions.withColumn("k", key).where("k <> 0")
    text = F.when(F.col("k") == 1, F.concat("text", F.lit(" revised wording"))).when(F.col("k") == 2, F.concat(F.lit("lead "), F.col("text"))).otherwise(F.col("text"))
    path = F.when(F.col("k") == 3, F.concat(F.lit("moved_"), F.col("path"))).otherwise(F.col("path"))
    r = r.select(path.alias("path"), F.col("ordinal").alias("o"), text.alias("text"))
    o = F.row_number().over(W.partitionBy("path").orderBy("o")).cast("long")
    return r.select("path", o.alias("ordinal"), "text").withColumn("ref", F.concat("path", F.lit(":"), F.format_string("P%02d", F.col("ordinal"))))


def revision_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """L1: each stable ref as added, removed, changed or unchanged by region hash."""
    a = old.select("ref", T.region_hash(F.col("text")).alias("ha"))
    b = new.select("ref", T.region_hash(F.col("text")).alias("hb"))
    state = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed").otherwise("unchanged")
    return a.join(b, "ref", "full_outer").select("ref", state.alias("state"))


def stale_examples(gold: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """L2: examples whose gold refs are missing from the new revision or changed there."""
    saved = gold.join(old.select("ref", T.region_hash(F.col("text")).alias("saved")), "ref")
    j = saved.join(new.select("ref", T.region_hash(F.col("text")).alias("now")), "ref", "left")
    g = j.groupBy("query_id").agg(F.count_if(F.col("now").isNull()).alias("missing"), F.count_if(F.col("now") != F.col("saved")).alias("changed"))
    return g.where("missing > 0 or changed > 0")


def stale_refs(gold: DataFrame, diff: DataFrame) -> DataFrame:
    """L3: (query_id, missing, changed): sorted refs of each example that a revision diff removed or changed, as they are named (no ranges)."""
    hit = gold.join(diff.where("state in ('removed', 'changed')"), "ref")
    refs = lambda s: F.sort_array(F.array_compact(F.collect_list(F.when(F.col("state") == s, F.col("ref")))))
    return hit.groupBy("query_id").agg(refs("removed").alias("missing"), refs("changed").alias("changed"))


def manifest_counts(diff: DataFrame) -> DataFrame:
    """One row of counts of a revision diff, with the share of old refs that are gone or changed."""
    n = {s: F.count_if(F.col("state") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")}
    d = diff.agg(*n.values())
    return d.withColumn("churn", F.round((F.col("removed") + F.col("changed")) / F.greatest(F.col("removed") + F.col("changed") + F.col("unchanged"), F.lit(1)), 6))


def diff_status(counts: DataFrame, maximum: dict[str, float]) -> DataFrame:
    """Per metric pass or fail against a maximum."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("maximum")) for m, v in maximum.items()]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*").withColumn("status", F.when(F.col("value") <= F.col("maximum"), "pass").otherwise("fail"))


def revisions_diff(old: DataFrame, revisions: DataFrame) -> DataFrame:
    """One old corpus against many new ones (a `revision` column), all in one join: counts per revision and state."""
    a = old.select("ref", T.region_hash(F.col("text")).alias("ha"))
    names = revisions.select("revision").distinct()
    a = a.crossJoin(F.broadcast(names))
    b = revisions.select("revision", "ref", T.region_hash(F.col("text")).alias("hb"))
    state = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed").otherwise("unchanged")
    return a.join(b, ["revision", "ref"], "full_outer").groupBy("revision", state.alias("state")).agg(F.count("*").alias("n"))


def method_totals(outcomes: DataFrame, by: str = "artifact") -> DataFrame:
    """Counts of several artifacts summed first and divided then, so that large ones weigh by their labels."""
    n = outcomes.groupBy("method", "outcome").agg(F.count("*").alias("n"), F.countDistinct(by).alias("artifacts"))
    return n.withColumn("rate", F.round(F.col("n") / F.sum("n").over(W.partitionBy("method")), 4))


def _overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ref, cand, shared, n, m): shared tokens of every pair that has some."""
    x = a.select("ref", F.size("tok").alias("n"), F.explode("tok").alias("t"))
    y = b.select(F.col("ref").alias("cand"), F.size("tok").alias("m"), F.explode("tok").alias("t"))
    return x.join(y, "t").groupBy("ref", "cand", "n", "m").agg(F.count("*").alias("shared"))


def fuzzy_best(left: DataFrame, new: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """The most similar new region of Jaccard >= threshold per old one; same path wins ties, then the ref.

    A pair over the threshold shares `threshold` of the old tokens, so only the rarest n - ceil(threshold n) + 1 of them need to
    be joined; sizes must fit the band [int(t n), int(n / t) + 1].
    """
    nt = new.select("ref", "path", F.size("tok").alias("m"), F.explode("tok").alias("t"))
    df = nt.groupBy("t").agg(F.count("*").alias("df"))
    a = left.select("ref", "path", F.size("tok").alias("n"), F.explode("tok").alias("t")).join(df, "t", "left")
    pos = F.row_number().over(W.partitionBy("ref").orderBy(F.coalesce("df", F.lit(0)), "t"))
    a = a.withColumn("pos", pos).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
    c = a.select("ref", "path", "n", "t").join(nt.select(F.col("ref").alias("cand"), F.col("path").alias("cpath"), "m", "t"), "t")
    c = c.where((F.col("m") >= F.floor(F.col("n") * threshold)) & (F.col("m") <= F.floor(F.col("n") / threshold) + 1)).select("ref", "path", "cand", "cpath").distinct()
    full = c.join(left.select("ref", F.col("tok").alias("ta")), "ref").join(new.select(F.col("ref").alias("cand"), F.col("tok").alias("tb")), "cand")
    full = full.withColumn("sim", T.jaccard(F.col("ta"), F.col("tb"), 1.0)).where(F.col("sim") >= threshold)
    w = W.partitionBy("ref").orderBy(F.round("sim", 9).desc(), (F.col("path") != F.col("cpath")).cast("int"), "cand")
    return full.withColumn("r", F.row_number().over(w)).where("r = 1").select("ref", "cand", "sim")


def split_support(left: DataFrame, new: DataFrame, coverage: float = SPLIT, most: int = 3) -> DataFrame:
    """The `most` new regions of the largest overlap, if two or more and together they cover enough of the old tokens."""
    o = _overlaps(left, new)
    w = W.partitionBy("ref").orderBy(F.col("shared").desc(), "cand")
    top = o.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("ref", "cand", "r")
    cover = left.select("ref", F.col("tok").alias("ta")).join(top.join(new.select(F.col("ref").alias("cand"), F.col("tok").alias("tb")), "cand"), "ref")
    g = cover.groupBy("ref", "ta").agg(F.array_distinct(F.flatten(F.collect_list("tb"))).alias("u"), F.count("*").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "cand"))), lambda x: x["cand"]), ",").alias("cands"))
    c = F.size(F.array_intersect("ta", "u")) / F.greatest(F.size("ta"), F.lit(1))
    return g.where(F.col("k") >= 2).select("ref", "cands", c.alias("coverage")).where(F.col("coverage") >= coverage)


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """L4: (ref, status, candidate, confidence) by cascade: same path exact, moved exact, fuzzy, split support, stale.

    Copies within a path resolve to the last ordinal, moved ones to the first by (path, ordinal). Stale rows have confidence 0.
    """
    a, b = prepared(old), prepared(new)
    same = b.groupBy("path", "fp").agg(F.max_by("ref", "ordinal").alias("same_ref"))
    first = b.withColumn("r", F.row_number().over(W.partitionBy("fp").orderBy("path", "ordinal")))
    # the first region elsewhere: of the first two paths that have the text, one is another path
    heads = first.groupBy("fp", "path").agg(F.min(F.struct("ordinal", "ref")).alias("h")).withColumn("p", F.row_number().over(W.partitionBy("fp").orderBy("path"))).where("p <= 2")
    heads = heads.groupBy("fp").agg(*[F.max(F.when(F.col("p") == i, F.col(c))).alias(f"{n}{i}") for i in (1, 2) for c, n in (("path", "p"), ("h.ref", "r"))])
    j = a.join(same, ["path", "fp"], "left").join(heads, "fp", "left")
    moved = F.when(F.col("p1") != F.col("path"), F.col("r1")).otherwise(F.col("r2"))
    j = j.withColumn("moved_ref", moved).select("ref", "path", "tok", "same_ref", "moved_ref")
    exact = j.where("same_ref is not null or moved_ref is not null").select("ref", F.when(F.col("same_ref").isNotNull(), "same_file_exact").otherwise("moved_exact").alias("status"), F.coalesce("same_ref", "moved_ref").alias("candidate"), F.lit(1.0).alias("confidence"))
    rest = j.where("same_ref is null and moved_ref is null").select("ref", "path", "tok")
    fuzzy = fuzzy_best(rest, b).select("ref", F.lit("fuzzy").alias("status"), F.col("cand").alias("candidate"), F.col("sim").alias("confidence"))
    rest2 = rest.join(fuzzy.select("ref"), "ref", "left_anti")
    split = split_support(rest2, b).select("ref", F.lit("split_support").alias("status"), F.col("cands").alias("candidate"), F.col("coverage").alias("confidence"))
    stale = rest2.join(split.select("ref"), "ref", "left_anti").select("ref", F.lit("stale").alias("status"), F.lit(None).cast("string").alias("candidate"), F.lit(0.0).alias("confidence"))
    return exact.union(fuzzy).union(split).union(stale)


def methods(old: DataFrame, new: DataFrame, status: DataFrame) -> DataFrame:
    """The outcome of each cheaper method per old region, against the migration's status as the truth."""
    a, b = prepared(old), prepared(new)
    valid = status.select("ref", (F.col("status") != "stale").alias("valid"))
    at = b.select("path", "ordinal", F.col("fp").alias("cfp"), F.col("tok").alias("ctok"), F.col("quote8").alias("cq8"))
    files_new = b.groupBy("path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "fp"))), lambda x: x["fp"]), "\n"), 256).alias("fnew"))
    files_old = a.groupBy("path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "fp"))), lambda x: x["fp"]), "\n"), 256).alias("fold"))
    q = b.where("quote <> ''").groupBy("quote").agg(F.count("*").alias("hits"), F.min_by("tok", "ref").alias("qtok"))
    r = a.join(valid, "ref").join(at, ["path", "ordinal"], "left").join(files_old, "path").join(files_new, "path", "left").join(q, "quote", "left")
    hits = F.coalesce("hits", F.lit(0))
    v, same = F.col("valid"), F.coalesce(F.col("cfp") == F.col("fp"), F.lit(False))
    sim = T.jaccard(F.col("tok"), F.col("ctok"), 1.0)
    have = F.col("cfp").isNotNull()
    alert = F.when(v, "false_stale_alert").otherwise("true_stale_alert")
    near = have & (F.col("quote8") != "") & (F.col("quote8") == F.col("cq8")) & (sim >= LAYERED)
    qsim = T.jaccard(F.col("tok"), F.col("qtok"), 1.0)
    ok = F.when(v, "preserved").otherwise("silent_wrong")
    return r.select(
        "ref",
        "valid",
        F.when(~have, "missing").when(same | (sim >= FUZZY), "correct").otherwise("silent_wrong").alias("path_ordinal"),
        F.when(same, "preserved").otherwise(alert).alias("id_hash"),
        F.when(F.coalesce(F.col("fold") == F.col("fnew"), F.lit(False)), "preserved").otherwise(alert).alias("source_hash"),
        F.when(same, "preserved").when(hits == 1, ok).when(hits > 1, "review_needed").otherwise(alert).alias("hash_quote"),
        F.when(same, "preserved")
        .when(near, ok)
        .when((hits == 1) & (qsim >= FUZZY), ok)
        .when(v, "review_needed")
        .otherwise("true_stale_alert")
        .alias("layered"),
    )


METHODS = ["path_ordinal", "id_hash", "source_hash", "hash_quote", "layered"]


def method_table(outcomes: DataFrame) -> DataFrame:
    """Outcome counts and rates per method."""
    rows = outcomes.select("ref", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("outcome")) for m in METHODS])).alias("x")).select("x.*")
    g = rows.groupBy("method", "outcome").agg(F.count("*").alias("n"))
    return g.withColumn("rate", F.round(F.col("n") / F.sum("n").over(W.partitionBy("method")), 4))


def files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths kept, deleted and added."""
    a, b = old.select("path").distinct(), new.select("path").distinct()
    parts = [a.intersect(b).agg(F.count("*").alias("kept")), a.exceptAll(b).agg(F.count("*").alias("deleted")), b.exceptAll(a).agg(F.count("*").alias("added"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


#: State of a label -> (next action, priority).
DECISIONS = {"unchanged": ("keep_label", "low"), "moved": ("update_ref", "low"), "rewritten": ("review_rewrite_or_preserve", "medium"), "split_support": ("review_split", "medium"), "deleted": ("refresh_or_remove_label", "high")}


def decisions(status: DataFrame) -> DataFrame:
    """Each label's state, action and priority."""
    state = F.when(F.col("status") == "same_file_exact", F.when(F.col("candidate") == F.col("ref"), "unchanged").otherwise("moved")).when(F.col("status") == "moved_exact", "moved").when(F.col("status") == "fuzzy", "rewritten").when(F.col("status") == "split_support", "split_support").otherwise("deleted")
    table = F.create_map(*[F.lit(x) for k, v in DECISIONS.items() for x in (k, v[0])])
    prio = F.create_map(*[F.lit(x) for k, v in DECISIONS.items() for x in (k, v[1])])
    s = status.withColumn("state", state)
    return s.select("ref", "state", F.element_at(table, F.col("state")).alias("next_action"), F.element_at(prio, F.col("state")).alias("priority"), "candidate")


def rates(outcomes: DataFrame, status: DataFrame) -> DataFrame:
    """One summary row of a revision: automatic, review and stale rates, and what the naive method gets silently wrong."""
    r = lambda c: F.round(F.avg(c.cast("double")), 4)
    s = F.col("status")
    a = status.agg(F.count("*").alias("labels"), r(s.isin("same_file_exact", "moved_exact")).alias("auto_rate"), r(s.isin("fuzzy", "split_support")).alias("review_rate"), r(s == "stale").alias("stale_rate"))
    return a.crossJoin(outcomes.agg(r(F.col("path_ordinal") == "silent_wrong").alias("naive_silent_wrong_rate")))
