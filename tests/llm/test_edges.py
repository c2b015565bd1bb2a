"""Nulls, blank and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import classifier, divergence, langid, lm_bloom, maglev, media, mixing, packing, sketch_join, token_count

LONG = " ".join(f"tok{i % 5000}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \n\t", None, None, 3),
    (4, LONG, "en", "a", len(LONG)),
    (5, LONG, "en", "b", len(LONG)),
    (6, "the same short text", "fr", "b", 19),
    (6, "the same short text", "fr", "b", 19),
    (7, "the same short text", "fr", "b", 19),
    (8, "*** ||| $$$", "xx", "c", 11),
    (9, "one", "de", "c", 3),
    (None, "a row without an id", "en", "a", 19),
    (None, None, None, None, None),
]
EXTRA = ["slot", "node", "keys", "rank", "n", "h", "sequence", "__lost", "__rejected", "__slot", "Keep", "prior"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit(f"x-{c}") for c in EXTRA}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, 0, 1), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "lm": lambda d, labels: lm_bloom.score(d),
    "lm_stored": lambda d, labels: lm_bloom.score(d, lm_bloom.fit(d)),
    "sharding": lambda d, labels: maglev.place(d),
    "tokens": lambda d, labels: token_count.count_tokens(d),
    "rules": lambda d, labels: divergence.judge(d),
    "language": lambda d, labels: langid.identify_documents(d),
    "classifier": lambda d, labels: classifier.classify(d, labels),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(docs, empty, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted((r[0] or 0) for r in ROWS)
    assert OPERATORS[name](empty, labels).collect() == []
    again = OPERATORS[name](docs, labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_null_and_blank_results(docs, labels):
    lm = {r.doc_id: r for r in OPERATORS["lm"](docs, labels).collect() if r.doc_id}
    assert all(lm[i].n_tokens == 0 and lm[i].log_prob is None for i in (1, 2, 3)) and lm[4].n_tokens == 60_000
    tok = {r.doc_id: r for r in OPERATORS["tokens"](docs, labels).collect() if r.doc_id}
    assert tok[1].n_tokens == tok[2].n_tokens == 0 and tok[3].n_tokens > 0
    rules = {r.doc_id: r for r in OPERATORS["rules"](docs, labels).collect() if r.doc_id}
    assert all(rules[i].keep and rules[i].char_distance is None for i in (1, 2, 3, 6, 9))
    shard = {r.doc_id: r.shard for r in OPERATORS["sharding"](docs, labels).collect()}
    assert shard[6] is not None and shard[None] is not None
    lang = {r.doc_id: r for r in OPERATORS["language"](docs, labels).collect() if r.doc_id}
    assert all(lang[i].keep for i in (1, 2, 3, 9))


def test_classifier_without_labels_or_with_one_class(spark, docs, labels):
    assert {r.quality_prob for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r.quality_prob > 0.99 for r in classifier.classify(docs, labels.where("quality = 1")).collect())


def test_near_copies(docs, empty):
    got = {r.doc_id: (r.class_id, r.n_links) for r in sketch_join.near_links(docs).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (6, 1), 8: (8, 0), 9: (9, 0)}
    two = docs.select("doc_id", "text").where("doc_id = 7").union(docs.select(F.lit(7), F.lit(LONG)).limit(1)).union(docs.select("doc_id", "text").where("doc_id in (4, 6)"))
    assert {r.doc_id: (r.class_id, r.n_links) for r in sketch_join.near_links(two).collect()} == {4: (4, 1), 6: (6, 1), 7: (4, 2)}
    assert {r.doc_id for r in sketch_join.drop_near_copies(two).collect()} == {4, 6}
    kept = sketch_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 6, 8, 9]
    assert sketch_join.near_links(empty).collect() == [] and sketch_join.drop_near_copies(empty).collect() == []


def test_stages_keep_columns(docs, empty):
    for stage in (langid.keep_known, divergence.keep_typical, mixing.mix):
        assert stage(docs).columns == docs.columns and stage(empty).collect() == []
    assert langid.keep_known(docs).where("doc_id is null").count() == 2
    assert divergence.keep_typical(docs).where("doc_id in (1, 2, 3, 6, 9)").count() == 6


def test_mixing(docs, empty):
    plan = mixing.schedule(docs, block_tokens=1000)
    rows = plan.collect()
    assert {(r.source, r.doc_id) for r in rows} == {(r[3], r[0]) for r in ROWS}
    mixed = mixing.mix(docs, block_tokens=1000)
    six = sum(r.doc_id == 6 for r in rows)
    assert mixed.where("doc_id = 6").count() == 2 * six
    assert mixing.schedule(empty).collect() == []


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows) == sum(len((r[1] or "").split()) for r in ROWS)
    assert all((r.sequence is None) == (r.length == 0) for r in rows)
    assert sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id == 4 for r in rows) == -(-60_000 // packing.CAPACITY)
    assert packing.pack(empty).collect() == []


def test_media(spark):
    big = "<html>" + "x" * 3_000_000
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", big), (3, "u", big), (3, "u", "<p>other"), (None, None, big), (None, "v", None)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("digest", "shard", "offset", "payload", "owner", "k")})
    rows = media.media_columns(pages).collect()
    assert len(rows) == 7 and sum(r.digest is None and r.shard is None for r in rows) == 2
    assert {(r.page_id, r.kind, r.raw_bytes) for r in rows if r.digest} == {(2, "empty", 0), (3, "html", len(big)), (3, "text", 8), (None, "html", len(big))}
    assert len({(r.shard, r.offset) for r in rows if r.digest}) == 3
    assert media.media_columns(pages.limit(0)).collect() == []


def test_pages_without_language(spark):
    model = langid.fit_text(spark.createDataFrame([], "doc_id long, text string, lang string"))
    pages = spark.createDataFrame([(1, None, None), (2, "http://x.fr", "<p>" + "mots " * 20)], "page_id long, url string, html string")
    assert {(r.page_id, r.lang) for r in langid.identify_pages(pages, model).collect()} == {(1, "und"), (2, "und")}


def test_pipeline_stages(spark, docs, empty):
    for start in (docs, empty):
        d = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, None)
            if name != "packing":
                assert out.columns == docs.columns
                d = spark.createDataFrame(out.collect(), docs.schema)
        assert (out.count() > 0) == (start is docs)
