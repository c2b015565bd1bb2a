"""The registered queries: thin compositions of operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunkers, marking
from ..functions import text as T
from ..operators import alignment, discovery, evaluation, export, feedback, lifecycle, refs, regions, retrieval, scan, smells
from ..streaming import feedback_stream
from . import model as M

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def r6(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


# ---- regions


@query
def c_line_regions(s, d):
    return regions.linked(regions.with_hash(M.line_regions(s, d))).select("doc_id", "ref", "ordinal", "start_line", "end_line", "hash", "prev_ref", "next_ref")


@query
def c_ten_line_regions(s, d):
    r = regions.line_regions(M.table(s, d, "documents"), 10)
    return regions.with_hash(r).select("ref", "start_line", "end_line", "hash")


@query
def c_min_terms(s, d):
    return regions.linked(M.line_regions(s, d), min_terms=8).select("ref", "prev_ref", "next_ref")


@query
def c_word_windows(s, d):
    w = regions.word_windows(M.table(s, d, "documents"))
    return w.select("doc_id", "region_id", "start_word", "n_words", T.fingerprint(F.col("text")).alias("fingerprint"))


@query
def c_heading_parents(s, d):
    return regions.heading_parents(M.headed(s, d)).select("ref", "level", "parent_ref")


@query
def c_sections(s, d):
    return regions.section_map(M.headed(s, d)).select("heading_ref", "level", "parent_ref", "end_ref", "n_refs")


@query
def c_neighbour_units(s, d):
    return joined(regions.neighbour_units(M.line_regions(s, d)).select("ref", "context_refs"), "context_refs")


@query
def c_coarse_ranges(s, d):
    return regions.coarse_ranges(M.line_regions(s, d)).select("doc_id", "range_no", "start_ref", "end_ref", "n_refs", "tokens")


@query
def c_target_shapes(s, d):
    return regions.target_shapes(M.line_regions(s, d))


@query
def c_budget_prefix(s, d):
    return regions.budget_prefix(M.line_regions(s, d), 5000, "source", ["ref"]).select("source", "pos", "ref", "tokens", "used")


@query
def c_paragraph_chunks(s, d):
    return chunkers.chunk_documents(M.table(s, d, "documents"), "paragraph").drop("text")


@query
def c_token_chunks(s, d):
    return chunkers.chunk_documents(M.table(s, d, "documents"), "token").drop("text")


@query
def s_page_paragraphs(s, d):
    p = regions.page_paragraphs(M.table(s, d, "pages"))
    return p.select("page_id", "ordinal", T.digest16(F.col("text")).alias("hash"), F.length("text").cast("long").alias("n_chars"))


# ---- text features


@query
def t_token_stats(s, d):
    r = M.table(s, d, "documents").select("lang", F.explode(T.index_tokens(F.col("text"))).alias("token"))
    return r6(r.groupBy("lang").agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("vocabulary"), F.avg(F.length("token")).alias("mean_length")), "mean_length")


@query
def t_keywords(s, d):
    # words that don't count leave a null, so that places stay
    kept = F.transform(T.index_tokens(F.col("text")), lambda t: F.when((F.length(t) > 2) & ~t.isin(T.KEYWORD_STOP), t))
    return scan.frequent_tokens(M.table(s, d, "documents").select("doc_id", kept.alias("tokens")), 12)


@query
def t_local_view(s, d):
    return M.line_regions(s, d).select("ref", T.digest16(T.first_words(F.col("text"))).alias("summary_hash"), T.approx_tokens(F.col("text")).alias("approx_tokens"))


@query
def t_alignment_terms(s, d):
    terms = F.array_sort(T.align_terms(F.col("text")))
    return M.line_regions(s, d).select("ref", F.size(terms).cast("long").alias("n_terms"), F.array_join(terms, " ").alias("terms"))


@query
def t_number_units(s, d):
    n = M.line_regions(s, d).select("ref", F.posexplode(T.number_units(F.col("text"))).alias("pos", "x"))
    return n.select("ref", F.col("pos").cast("long").alias("pos"), F.col("x.number").alias("number"), F.col("x.unit").alias("unit"))


@query
def t_cues(s, d):
    return joined(M.line_regions(s, d).select("ref", T.cues(F.col("text"), M.LEXICON).alias("cues")), "cues")


@query
def t_quote_selectors(s, d):
    q = M.line_regions(s, d).select(T.quote(F.col("text")).alias("quote")).where("quote <> ''")
    return q.groupBy("quote").agg(F.count("*").alias("n"))


# ---- refs and context


@query
def r_citations(s, d):
    return M.citations(s, d).select("key", F.col("pos").cast("long").alias("pos"), "doc", "start_id", "end_doc", "end_id", "is_range", "ok")


@query
def r_expand_refs(s, d):
    return refs.expand_refs(M.citations(s, d), M.line_regions(s, d)).select("key", "ref").distinct()


@query
def r_validate_refs(s, d):
    cited = M.citations(s, d).select(F.concat_ws(":", "doc", "end_id").alias("ref")).union(M.table(s, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("ref")).distinct())
    return refs.validate_refs(cited, M.line_regions(s, d))


@query
def r_context(s, d):
    c = refs.expand_context(M.hits(s, d, 5), M.line_regions(s, d))
    return c.select("query_id", "ref")


@query
def r_context_pack(s, d):
    r = M.line_regions(s, d)
    context = scan.few(refs.expand_context(M.hits(s, d, 5), r), M.queries(s, d).count() * 5 * 3)
    p = refs.context_pack(context, r)
    return p.select("query_id", "n_refs", "token_estimate", T.digest16(F.col("text")).alias("hash"))


def _scored(s, d):
    p = M.hits(s, d, 3).groupBy("query_id").agg(F.collect_set("ref").alias("predicted"))
    g = M.gold(s, d).groupBy("query_id").agg(F.collect_set("ref").alias("gold"))
    none = F.array().cast("array<string>")
    e = M.examples(s, d).join(p, "query_id", "left").join(g, "query_id", "left").withColumns({"predicted": F.coalesce("predicted", none), "gold": F.coalesce("gold", none)})
    return refs.citation_reward(refs.score_sets(e))


@query
def r_score_sets(s, d):
    return r6(_scored(s, d).drop("predicted", "gold"), "precision", "recall", "f1", "jaccard", "breadth", "reward")


@query
def r_score_summary(s, d):
    m = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return _scored(s, d).groupBy("style").agg(F.count("*").alias("n"), *[m(c) for c in ("precision", "recall", "f1", "jaccard", "breadth", "exact", "cover", "overcite", "undercite", "wrong", "reward")])


# ---- retrieval


@query
def x_index_stats(s, d):
    return r6(retrieval.index_stats(retrieval.tokenized(M.line_regions(s, d))), "idf")


@query
def x_postings(s, d):
    p = retrieval.postings(retrieval.tokenized(M.line_regions(s, d)))
    return p.select("token", "df", F.round("idf", 6).alias("idf"), T.digest16(F.col("postings")).alias("hash"))


@query
def x_search(s, d):
    return r6(M.hits(s, d), "score")


@query
def x_search_hierarchical(s, d):
    return r6(retrieval.search_hierarchical(M.line_regions(s, d), M.queries(s, d)), "score", "group_score")


@query
def x_area_router(s, d):
    return r6(retrieval.search_hierarchical(M.line_regions(s, d), M.queries(s, d), 3, 10, "source"), "score", "group_score")


@query
def x_rerank(s, d):
    return r6(retrieval.rerank(M.line_regions(s, d), M.queries(s, d)), "score")


@query
def x_tfidf(s, d):
    t = retrieval.tfidf(retrieval.tokenized(M.line_regions(s, d)), M.queries(s, d), 10)
    return r6(t, "score").select("query_id", "rank", F.col("unit").alias("ref"), "score")


@query
def x_rrf(s, d):
    h = M.strategy_hits(s, d, "flat", "reranked")
    return r6(retrieval.rrf([(h["flat"], 1.0), (h["reranked"], 0.5)]), "score", places=9)


def _summary_field(s, d):
    return M.line_regions(s, d).withColumn("text", T.first_words(F.col("text")))


@query
def x_fielded_rrf(s, d):
    q = M.queries(s, d)
    lists = [(retrieval.search(M.line_regions(s, d), q, 50), 1.0), (retrieval.search(_summary_field(s, d), q, 50), 0.6)]
    return r6(retrieval.rrf(lists), "score", places=9)


@query
def x_hybrid(s, d):
    r, q = M.line_regions(s, d), M.queries(s, d)
    dense = retrieval.tfidf(retrieval.tokenized(r), q, 50).select("query_id", F.col("unit").alias("ref"), "score")
    return r6(retrieval.hybrid(retrieval.search(r, q, 50), dense), "score")


@query
def x_weight_grid(s, d):
    h = M.strategy_hits(s, d, "flat", "hierarchical")
    a = h["flat"].select("query_id", "ref", F.col("rank").alias("ra"))
    b = h["hierarchical"].select("query_id", "ref", F.col("rank").alias("rb"))
    ranks = a.join(b, ["query_id", "ref"], "full_outer")
    grid = s.createDataFrame([(x, y) for x in (0.5, 1.0, 2.0) for y in (0.5, 1.0, 2.0)], "wa double, wb double")
    score = F.coalesce(F.col("wa") / (60 + F.col("ra")), F.lit(0.0)) + F.coalesce(F.col("wb") / (60 + F.col("rb")), F.lit(0.0))
    fused = ranks.crossJoin(F.broadcast(grid)).withColumn("score", score).withColumn("key", F.concat_ws("/", F.col("wa").cast("string"), F.col("wb").cast("string"), F.col("query_id").cast("string")))
    top = retrieval.top_k(fused, 10, by="key", unit="ref")
    g = M.gold(s, d).withColumn("g", F.lit(1))
    first = top.join(g, ["query_id", "ref"]).groupBy("wa", "wb", "query_id").agg(F.min("rank").alias("first"))
    n = M.gold(s, d).agg(F.countDistinct("query_id").alias("n"))
    out = first.groupBy("wa", "wb").agg(F.count("*").alias("hit"), F.sum(1 / F.col("first")).alias("rr")).crossJoin(n)
    return out.select("wa", "wb", F.round(F.col("hit") / F.col("n"), 6).alias("hit_at_10"), F.round(F.col("rr") / F.col("n"), 6).alias("mrr"))


@query
def x_gated(s, d):
    h = M.strategy_hits(s, d, "flat", "reranked")
    return retrieval.gated(h["flat"], h["reranked"], [1.2, 1.35])


@query
def x_dense_top_k(s, d):
    v = M.vectors(s, d)
    t = retrieval.dense_top_k(v.select(F.col("vec_id").alias("query_id"), "v"), v.select(F.col("vec_id").alias("unit"), "v"), 5)
    return r6(t.select("query_id", "rank", "unit", "score"), "score")


@query
def x_centroids(s, d):
    return r6(retrieval.nearest_centroid(M.vectors(s, d)).select("vec_id", F.col("label").cast("long").alias("label"), F.col("predicted").cast("long").alias("predicted"), "score"), "score")


@query
def x_top_variance(s, d):
    return r6(retrieval.top_variance(M.vectors(s, d)), "variance", "scale", places=9)


@query
def x_signatures(s, d):
    u = M.table(s, d, "documents").select(F.col("lang").alias("unit"), "text")
    return r6(retrieval.signatures(u), "score")


@query
def x_expansion_terms(s, d):
    u = M.table(s, d, "documents").select(F.col("doc_id").alias("unit"), "text")
    return r6(retrieval.expansion_terms(u), "score")


# ---- evaluation


@query
def e_results(s, d):
    r = M.results(s, d)
    return r6(joined(r, "gold_refs", "context").drop("top_score", "second_score"), "rr", "coverage", "precision", "margin", "margin_ratio")


METRICS = ("hit_at_1", "hit_at_k", "mrr", "coverage", "precision", "avg_context")


@query
def e_summary(s, d):
    return r6(evaluation.summarize(M.results(s, d)), *METRICS)


@query
def e_by_style_and_mode(s, d):
    return r6(evaluation.by_style_and_mode(M.results(s, d)), *METRICS)


@query
def e_style_gap(s, d):
    return r6(evaluation.style_gap(M.results(s, d)), "gap")


@query
def e_heatmap(s, d):
    return evaluation.heatmap(M.results(s, d))


@query
def e_confusions(s, d):
    return evaluation.confusions(M.results(s, d))


@query
def e_jump_curve(s, d):
    r = M.results(s, d)
    return r6(evaluation.jump_curve(r, evaluation.quantile_thresholds(r)), "threshold", "coverage", "precision_at_1", "hit_at_k")


@query
def e_compare_strategies(s, d):
    return r6(evaluation.best_strategy(M.strategies(s, d)), *METRICS)


@query
def e_deltas(s, d):
    return evaluation.deltas(M.strategies(s, d), "flat")


@query
def e_ci_status(s, d):
    return r6(evaluation.ci_status(evaluation.summarize(M.results(s, d)), {"hit_at_1": 0.2, "hit_at_k": 0.4, "mrr": 0.9}), "value")


@query
def e_rank_summary(s, d):
    return evaluation.rank_summary(M.results(s, d))


@query
def e_neighbour_windows(s, d):
    return r6(evaluation.neighbour_rank(M.hits(s, d), M.gold(s, d), M.line_regions(s, d)).withColumn("width", F.col("width").cast("long")), "hit_rate", "mrr")


def _labelled(s, d):
    return M.table(s, d, "documents").select("doc_id", "n_chars").join(M.table(s, d, "labels"), "doc_id")


@query
def e_auc(s, d):
    return r6(evaluation.auc(_labelled(s, d), "n_chars", "quality"), "auc")


@query
def e_calibration(s, d):
    return r6(evaluation.calibration(_labelled(s, d), "n_chars", "quality", "doc_id"), "mean_score", "positive_rate")


@query
def e_split(s, d):
    return evaluation.split(M.table(s, d, "documents").select("doc_id", "source"), "doc_id", "source").select("doc_id", "part")


@query
def e_range_scores(s, d):
    """Hits and gold at the level of coarse ranges of five regions."""
    from pyspark.sql.window import Window as W

    r = M.line_regions(s, d)
    pos = r.select("ref", "doc_id", F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal")) - 1) / 5).alias("no")).select("ref", F.concat_ws("#", "doc_id", F.col("no").cast("string")).alias("rng"))
    h = M.hits(s, d).join(pos, "ref").groupBy("query_id", "rng").agg(F.min("rank").alias("rank"))
    g = M.gold(s, d).join(pos, "ref").select("query_id", "rng").distinct()
    hit = h.join(g, ["query_id", "rng"]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    per = g.groupBy("query_id").agg(F.count("*").alias("ranges")).join(hit, "query_id", "left")
    return per.select("query_id", "ranges", F.coalesce("found", F.lit(0).cast("long")).alias("found"), "first")


# ---- alignment


@query
def a_align(s, d):
    return alignment.align(M.queries(s, d).select(F.concat(F.lit("b"), "query_id").alias("ref"), F.col("query").alias("text")), M.line_regions(s, d))


def _coverage(s, d):
    return alignment.coverage(M.queries(s, d).select(F.concat(F.lit("b"), "query_id").alias("ref"), F.col("query").alias("text")), M.line_regions(s, d))


@query
def a_coverage(s, d):
    return joined(_coverage(s, d).drop("numeric_conflict"), "missing_terms")


@query
def a_coverage_summary(s, d):
    return alignment.coverage_summary(_coverage(s, d))


# ---- smells


@query
def d_exact_duplicates(s, d):
    return smells.exact_duplicates(M.line_regions(s, d))


@query
def d_near_duplicates(s, d):
    return smells.near_duplicates(M.line_regions(s, d))


@query
def d_oversized(s, d):
    return smells.oversized(M.line_regions(s, d))


@query
def d_conflicts(s, d):
    return smells.conflicts(M.line_regions(s, d), M.LEXICON, M.PAIRS)


@query
def d_index_smells(s, d):
    return smells.index_smells(M.line_regions(s, d), M.LEXICON, M.PAIRS)


def _run_smells(s, d, results=None, contradictions=20):
    stale = lifecycle.stale_refs(M.gold(s, d), lifecycle.revision_diff(M.old(s, d), M.new(s, d)))
    return smells.run_smells(M.results(s, d) if results is None else results, M.line_regions(s, d), M.gold(s, d), stale=stale, lexicon=M.LEXICON, pairs=M.PAIRS, most_contradictions=contradictions)


@query
def d_run_smells(s, d):
    return _run_smells(s, d)


@query
def d_adaptation_plan(s, d):
    every = smells.contradictory(smells.contradictions(M.line_regions(s, d), M.LEXICON, M.PAIRS))
    return smells.adaptation_plan(_run_smells(s, d, contradictions=0), every)


@query
def d_compare_reports(s, d):
    g, e = M.gold(s, d), M.examples(s, d)
    h = M.strategy_hits(s, d, "flat", "reranked")
    mode = F.when(F.col("n_gold") <= 1, "single").otherwise("distributed")
    a, b = (_run_smells(s, d, evaluation.evaluate(h[k], g, e).withColumn("mode", mode), 0) for k in ("flat", "reranked"))
    # contradictions come from the regions alone: all are in both reports
    every = smells.contradiction_count(M.line_regions(s, d), M.LEXICON, M.PAIRS).select(F.lit("contradictory_support").alias("type"), "n")
    return smells.compare(a, b, every)


# ---- feedback


@query
def f_clusters(s, d):
    known = M.table(s, d, "events").select(F.concat(F.lit("r"), (F.get_json_object("props", "$.k").cast("int") % 15).cast("string")).alias("ref"))
    return feedback.clusters(M.events(s, d), known).select("query", "n", "no_answer", "negative", "top", "top_n", "target", "target_n", F.coalesce("target_kinds", F.lit(0).cast("long")).alias("target_kinds"), "missing")


@query
def f_actions(s, d):
    return feedback.actions(feedback.clusters(M.events(s, d)))


@query
def f_ordered(s, d):
    return feedback.ordered(feedback.clusters(M.events(s, d)), 25)


@query
def f_windows(s, d):
    w = feedback_stream.query_windows(M.events(s, d))
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# ---- lifecycle


@query
def l_revision_diff(s, d):
    return lifecycle.revision_diff(M.old(s, d), M.new(s, d))


@query
def l_stale_examples(s, d):
    return lifecycle.stale_examples(M.gold(s, d), M.old(s, d), M.new(s, d))


@query
def l_migration(s, d):
    return r6(lifecycle.migrate(M.old(s, d), M.new(s, d)), "confidence")


@query
def l_decisions(s, d):
    x = lifecycle.decisions(lifecycle.migrate(M.old(s, d), M.new(s, d)))
    return x.groupBy("state", "next_action", "priority").agg(F.count("*").alias("n"))


@query
def l_method_table(s, d):
    o, n = M.old(s, d), M.new(s, d)
    return lifecycle.method_table(lifecycle.methods(o, n, lifecycle.migrate(o, n)))


@query
def l_files(s, d):
    return lifecycle.files(M.old(s, d), M.new(s, d))


# ---- discovery


@query
def v_top_terms(s, d):
    return discovery.top_terms(M.line_regions(s, d))


@query
def v_abbreviations(s, d):
    return discovery.top_terms(M.line_regions(s, d), discovery.abbreviations, 30)


@query
def v_range_candidates(s, d):
    return discovery.range_candidates(M.line_regions(s, d))


@query
def v_roles(s, d):
    return discovery.roles(M.line_regions(s, d)).select(F.explode("roles").alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query
def v_doc_clusters(s, d):
    return discovery.doc_clusters(M.line_regions(s, d))


@query
def v_tree_clusters(s, d):
    return discovery.tree_clusters(M.line_regions(s, d), "lang", "source")


@query
def v_tag_graph(s, d):
    return discovery.tag_graph(M.line_regions(s, d))


@query
def v_windows(s, d):
    return discovery.windows(M.line_regions(s, d))


@query
def v_windowed_terms(s, d):
    return discovery.windowed_terms(M.line_regions(s, d))


@query
def v_question_plan(s, d):
    return discovery.question_plan(discovery.roles(M.line_regions(s, d)))


@query
def v_local_questions(s, d):
    r = M.line_regions(s, d)
    topics = r.select("ref", F.array_join(F.slice(F.array_distinct(discovery.tokens(F.col("text"))), 1, 3), ", ").alias("topic"))
    return discovery.local_questions(discovery.question_plan(discovery.roles(r)), topics)


@query
def v_review(s, d):
    r = M.line_regions(s, d)
    return discovery.review(r, discovery.tag_graph(r), discovery.question_plan(discovery.roles(r)))


# ---- export and marking


@query
def p_evidence_metrics(s, d):
    return r6(export.evidence_metrics(M.results(s, d), M.line_regions(s, d)), "hit_at_1", "mrr", "avg_overcitation", "avg_undercitation", "avg_support_tokens")


@query
def p_qrels(s, d):
    return export.qrels(M.gold(s, d))


@query
def p_document_metadata(s, d):
    return export.document_metadata(M.line_regions(s, d))


@query
def p_trace_events(s, d):
    return export.trace_events(M.results(s, d))


@query
def p_answer_rows(s, d):
    return export.answer_rows(M.results(s, d), M.line_regions(s, d))


@query
def m_mark_and_strip(s, d):
    """M1, M2: marking and stripping leave every text as it was."""
    t = M.table(s, d, "documents").select("doc_id", "text", marking.strip_udf(marking.inject_udf(F.col("text"))).alias("back"))
    return t.select("doc_id", (F.col("text") == F.col("back")).alias("same"))


# ---- secondary operators


@query
def r_section_of(s, d):
    return regions.section_of(M.headed(s, d))


@query
def c_sliding_areas(s, d):
    return regions.sliding_areas(M.table(s, d, "documents"), "source")


@query
def c_distractors(s, d):
    return regions.distractors(M.line_regions(s, d)).select("ref", T.digest16(F.col("text")).alias("hash"))


@query
def t_hashed_features(s, d):
    return r6(T.hashed_features(M.table(s, d, "documents").select("doc_id", "text"), "doc_id"), "weight")


@query
def e_even_sample(s, d):
    return evaluation.even_sample(M.table(s, d, "documents").select("doc_id", "lang"), 50, ["doc_id"])


@query
def l_rates(s, d):
    o, n = M.old(s, d), M.new(s, d)
    status = lifecycle.migrate(o, n)
    return lifecycle.rates(lifecycle.methods(o, n, status), status)


@query
def p_tool_summary(s, d):
    return r6(export.tool_summary(M.results(s, d), M.line_regions(s, d), M.gold(s, d)), "hit_at_k", "mrr")
