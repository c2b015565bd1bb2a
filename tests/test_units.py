"""Operators on small fixtures with known results."""

import zipfile

import pytest
from pyspark.sql import functions as F

from spanforge.functions import chunkers, marking
from spanforge.functions import text as T
from spanforge.operators import alignment, discovery, evaluation, feedback, lifecycle, refs, regions, retrieval, smells
from spanforge.sources import corpus
from spanforge.streaming import feedback_stream


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first().x


def make(spark, rows):
    return spark.createDataFrame([(d, f"P{i:02d}", f"{d}:P{i:02d}", i, t) for d, i, t in rows], "doc_id string, region_id string, ref string, ordinal long, text string")


def test_chunkers():
    text = "a\nb\n\n```\ncode\n```\nc\n> quote\nd"
    assert [c[:2] for c in chunkers.paragraph_chunks(text)] == [(1, 2), (7, 7), (9, 9)]
    assert [c[:2] for c in chunkers.line_chunks("1\n2\n3", 2)] == [(1, 2), (3, 3)]
    assert [c[:2] for c in chunkers.token_chunks("a b c\nd e f\ng", 6)] == [(1, 2), (3, 3)]
    code = "import os\n\nx = 1\n\n\nclass A:\n    y = 2\n\n    def f(self):\n        pass\n\n    def g(self):\n        pass\n"
    assert [c[2] for c in chunkers.python_chunks(code)] == ["import", "module", "class"]
    assert [c[2] for c in chunkers.python_chunks(code, True)] == ["import", "module", "class", "method", "method"]
    assert chunkers.python_chunks("def (")[0][2] == "line"
    assert chunkers.label("function", 101) == "F101"
    assert chunkers.safe_windows([5, 5, 5, 20, 1], 10, 1) == [(0, 2), (1, 3), (2, 3), (3, 4), (4, 5)]


def test_marking_round_trip_and_edits():
    text = "first one\n\nsecond one\n\nthird"
    marked = marking.inject(text)
    assert marking.is_marked(marked) and not marking.is_marked(text)
    assert marking.strip(marked) == text
    assert [b[0] for b in marking.blocks(marked)] == ["P01", "P02", "P03"]
    out = marking.apply_edits(marked, [{"ref": "P02", "action": "replace", "text": "2nd\n"}, {"ref": "P03", "action": "delete"}])
    assert marking.strip(out).startswith("first one\n\n2nd")
    assert "third" not in out
    with pytest.raises(marking.EditError):
        marking.apply_edits(marked, [{"ref": "P02", "action": "delete"}, {"ref": "P02", "action": "delete"}])
    with pytest.raises(marking.EditError):
        marking.search_replace("a a", "a", "b")
    assert marking.unified_diff("a\nb\nc", "@@ -1,3 +1,3 @@\n a\n-b\n+B\n c") == "a\nB\nc"
    assert marking.line_edits("a\nb\nc", [{"start": 2, "end": 3, "expected": "b", "text": "x\ny"}]) == "a\nx\ny\nc"
    py = marking.inject("import os\nx = 1\n", ".py", "ast")
    with pytest.raises(marking.EditError):
        marking.apply_edits(py, [{"ref": "G02", "action": "replace", "text": "x = ("}], ".py")
    assert "> " in marking.highlight(marked, ["P02"], 0)
    assert marking.side_by_side("a\nb", "a\nc")[1] == ("replace", "b", "c")


def test_text_features(spark):
    assert one(spark, T.index_tokens(F.col("t")), t="Über-Maß a_1!") == ["über", "maß", "a_1"]
    assert one(spark, F.array_sort(T.align_terms(F.col("t"))), t="The policies are encrypted and stored") == ["encryption", "policy", "stor"]
    assert one(spark, T.approx_tokens(F.col("t")), t="abcde") == 2
    assert one(spark, T.cues(F.col("t")), t="You must not; mustard") == ["must", "must_not"]
    assert one(spark, T.numeric_conflict(F.col("a"), F.col("b")), a="at least 500 kWh", b="provides 520 kWh") is False
    assert one(spark, T.numeric_conflict(F.col("a"), F.col("b")), a="within 90 days", b="after 120 days") is True
    assert one(spark, T.bigrams(T.index_tokens(F.col("t"))), t="a b a b") == ["a b", "b a"]
    assert one(spark, T.bigrams(T.index_tokens(F.col("t"))), t="a") == []


def test_sections_and_parents(spark):
    r = make(spark, [("d", 1, "# A"), ("d", 2, "text"), ("d", 3, "## B"), ("d", 4, "more"), ("d", 5, "# C")])
    parents = {x.ref: x.parent_ref for x in regions.heading_parents(r).collect()}
    assert parents == {"d:P01": None, "d:P02": "d:P01", "d:P03": "d:P01", "d:P04": "d:P03", "d:P05": None}
    ends = {x.heading_ref: (x.end_ref, x.n_refs) for x in regions.section_map(r).collect()}
    assert ends == {"d:P01": ("d:P04", 4), "d:P03": ("d:P04", 2), "d:P05": ("d:P05", 1)}


def test_citations(spark):
    df = spark.createDataFrame([("[P1, P03-P05, policy:P07-policy:P08, a:P1-b:P2]",)], "c string")
    got = [(r.doc, r.start_id, r.end_id, r.is_range, r.ok) for r in refs.parse_citations(df, "c").orderBy("pos").collect()]
    assert got == [(None, "P01", "P01", False, True), (None, "P03", "P05", True, True), ("policy", "P07", "P08", True, True), ("a", "P01", "P02", True, False)]


def test_score_and_reward(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b", "c", "d"], ["a"]), (["x"], ["a"]), ([], [])], "predicted array<string>, gold array<string>")
    got = [(r.precision, r.recall, r.exact, r.wrong, round(r.reward, 4)) for r in refs.citation_reward(refs.score_sets(df)).collect()]
    assert got[0] == (1.0, 1.0, True, False, 1.0)
    assert got[1][:2] == (0.25, 1.0) and got[1][4] == round(0.55 * 0.4 + 0.35 - 0.45, 4)
    assert got[2][3] and got[2][4] == 0.0
    assert got[3][:3] == (1.0, 1.0, True)
    s = refs.span_metrics(spark.createDataFrame([(0, 10, 5, 15)], "pred_start int, pred_end int, gold_start int, gold_end int")).first()
    assert (s.overlap, s.precision, round(s.iou, 4)) == (5, 0.5, 0.3333)


def test_search_excludes_but_counts(spark):
    r = make(spark, [("release_notes", 1, "audit log changes"), ("security", 1, "other text here"), ("security", 2, "the audit log is kept")])
    r = r.withColumn("search_excluded", F.col("doc_id") == "release_notes")
    q = spark.createDataFrame([(1, "audit log")], "query_id long, query string")
    assert [x.ref for x in retrieval.search(r, q, 5, False).orderBy("rank").collect()] == ["security:P02"]
    assert len(retrieval.search(r, q, 5).collect()) == 2


def test_evaluation_of_expanded_context(spark):
    hits = spark.createDataFrame([(1, 1, "d:P01", 2.0, ["d:P01", "d:P02"]), (2, 1, "d:P03", 1.0, ["d:P03"])], "query_id long, rank long, ref string, score double, context_refs array<string>")
    gold = spark.createDataFrame([(1, "d:P02"), (2, "d:P01")], "query_id long, ref string")
    ex = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "query_id long, style string")
    rows = {r.query_id: r for r in evaluation.evaluate(hits, gold, ex).collect()}
    assert rows[1].hit_at_1 and rows[1].coverage == 1.0 and rows[1].precision == 0.5
    assert not rows[2].hit_at_k and rows[3].coverage == 0.0 and rows[3].n_gold == 0


def test_coverage_by_neighbour(spark):
    src = make(spark, [("s", 1, "backup retention encryption keys rotate yearly"), ("s", 2, "zebra quartz")])
    tgt = make(spark, [("t", 1, "backup retention"), ("t", 2, "encryption keys rotate yearly"), ("t", 3, "unrelated words")])
    got = {r.source_ref: r for r in alignment.coverage(src, tgt).collect()}
    assert got["s:P01"].status == "covered" and got["s:P01"].expanded_score >= got["s:P01"].naive_score
    assert got["s:P02"].status == "gap" and got["s:P02"].target_ref is None


def test_feedback(spark):
    schema = "event_id long, query string, top_refs array<string>, clicked_ref string, selected_ref string, useful boolean, no_answer boolean"
    e = spark.createDataFrame([(i, q, ["d:P01"], None, "d:P02", None, False) for i, q in enumerate(["How  to", "how to", "HOW TO"])], schema)
    c = feedback.clusters(e).first()
    assert (c.n, c.top, c.top_n, c.target) == (3, "d:P01", 3, "d:P02")
    assert {r.action for r in feedback.actions(feedback.clusters(e)).collect()} == {"add_shadow_alias_or_doc2query", "record_confusion_pair"}
    e = spark.createDataFrame([(i, "q", ["d:P01"], None, None, False, True) for i in range(2)], schema)
    assert {r.action for r in feedback.actions(feedback.clusters(e)).collect()} == {"review_query_magnet", "review_no_answer_or_missing_coverage"}


def rows_of(spark, rows):
    return spark.createDataFrame([(p, f"{p}:P{o:02d}", o, t) for p, o, t in rows], "path string, ref string, ordinal long, text string")


def test_lifecycle_of_a_moved_region(spark):
    text = " ".join(f"word{i}" for i in range(30))
    old = rows_of(spark, [("a", 1, text)])
    new = rows_of(spark, [("b", 1, text), ("a", 1, "something else entirely")])
    status = lifecycle.migrate(old, new)
    assert status.first().status == "moved_exact"
    m = lifecycle.methods(old, new, status).first()
    assert (m.path_ordinal, m.id_hash, m.source_hash, m.hash_quote, m.layered) == ("silent_wrong", "false_stale_alert", "false_stale_alert", "preserved", "preserved")


def test_lifecycle_ambiguous_quote_and_split(spark):
    text = " ".join(f"word{i}" for i in range(30))
    old = rows_of(spark, [("a", 1, text)])
    new = rows_of(spark, [("b", 1, text), ("c", 1, text)])
    m = lifecycle.methods(old, new, lifecycle.migrate(old, new)).first()
    assert m.hash_quote == "review_needed" and m.layered == "review_needed"
    words = text.split()
    new = rows_of(spark, [("a", 1, " ".join(words[:15])), ("a", 2, " ".join(words[15:]))])
    assert lifecycle.migrate(old, new).first().status == "split_support"
    assert lifecycle.migrate(old, rows_of(spark, [("a", 1, "nothing alike")])).first().status == "stale"


def test_smells(spark):
    must, may = "the backup archive service must encrypt stored records daily", "the backup archive service may encrypt stored records daily"
    r = make(spark, [("d", 1, must), ("d", 2, may), ("e", 1, "a changelog of things"), ("e", 2, must)])
    assert {x.ref for x in smells.magnets(r).collect()} == {"e:P01"}
    assert smells.exact_duplicates(r).first().n == 2
    assert {(x.left_ref, x.right_ref) for x in smells.conflicts(r).collect()} == {("d:P01", "d:P02"), ("d:P02", "e:P02")}
    assert {(x.left_ref, x.right_ref) for x in smells.contradictions(r).collect()} == {("d:P01", "d:P02"), ("d:P02", "e:P02")}
    assert {(x.left_ref, x.right_ref) for x in smells.near_duplicates(r).collect()} >= {("d:P01", "e:P02")}


def test_discovery_balances(spark):
    r = make(spark, [("d", i, t) for i, t in enumerate(["apple orchard harvest cider", "apple orchard harvest", "engine piston valve crank", "engine piston valve"], 1)])
    got = {x.ref: x.seed_ref for x in discovery.balanced_clusters(r, 2).collect()}
    assert got["d:P01"] == got["d:P02"] != got["d:P03"] == got["d:P04"]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "A b.md").write_text("\ufeffhello", encoding="utf-8")
    (tmp_path / "sub" / "x.txt").write_text("there")
    (tmp_path / "skip.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>')
    got = {r.doc_id: r.text for r in corpus.read_corpus(spark, str(tmp_path), exclude=["skip*"]).collect()}
    assert got == {"a_b": "hello", "sub_x": "there", "w": "one\n\ntwo"}


def test_jsonl_events(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text('{"query": "q", "shown_refs": ["a"], "click_ref": "a", "feedback": "bad"}\n\n{"query": "r", "top_refs": ["b"], "no_answer": true}\n')
    rows = {r.query: r for r in corpus.read_events(spark, str(p)).collect()}
    assert rows["q"].top_refs == ["a"] and rows["q"].clicked_ref == "a" and rows["q"].useful is False
    assert rows["r"].no_answer and rows["r"].useful is None


def test_feedback_stream(spark, tmp_path):
    from datetime import datetime

    schema = "ts timestamp, query string, useful boolean, no_answer boolean"
    rows = [(datetime(2024, 1, 1, 0, m), "Q  x", None, m % 2 == 0) for m in (1, 2, 3)] + [(datetime(2024, 1, 1, 5), "z", None, False)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = feedback_stream.query_windows(stream).writeStream.format("memory").queryName("fb").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.query, r.n, r.no_answer) for r in spark.table("fb").collect()}
    assert got == {("q x", 3, 1)}
