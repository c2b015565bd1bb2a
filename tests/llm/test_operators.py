"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import tarfile
from collections import Counter, defaultdict
from html.parser import HTMLParser
from itertools import combinations
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.llm import classifier, divergence, langid, lm_bloom, maglev, media, mixing, packing, queries, sketch_join, token_count
from spanforge.llm.common import Tokens, trim_word
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(text):
    return [w for w in map(trim_word, text.lower().split()) if w]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(connect(SF), queries.oracle_sql()[name])


def test_tokens_match_plain_python(texts):
    ids = sorted(texts)
    t = Tokens(pa.array([texts[i] for i in ids]))
    got = [[t.words[j] for j in t.ids[a:b]] for a, b in zip(t.offsets, t.offsets[1:], strict=False)]
    assert got == [words(texts[i]) for i in ids]


# ---- 1 language-model scoring


def brute_scores(corpus, order, base, mix):
    counts = [Counter(tuple(ws[i : i + n]) for ws in corpus.values() for i in range(len(ws) - n + 1)) for n in range(1, order + 1)]
    total, vocabulary = sum(counts[0].values()), len(counts[0])

    def rep(gram):
        c = counts[len(gram) - 1][gram]
        return float(lm_bloom.level_count(lm_bloom.gram_levels(np.array([c]), base), base)[0]) if c else 0.0

    out = {}
    for key, ws in corpus.items():
        s = 0.0
        for i in range(len(ws)):
            p = (rep((ws[i],)) + 1) / (total + vocabulary + 1)
            for n in range(2, order + 1):
                if i >= n - 1 and (h := rep(tuple(ws[i - n + 1 : i]))) > 0:
                    p = mix * min(1.0, rep(tuple(ws[i - n + 1 : i + 1])) / h) + (1 - mix) * p
            s += math.log(p)
        out[key] = (len(ws), s if ws else None)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, texts, order):
    want = brute_scores({k: words(t) for k, t in texts.items()}, order, 2.0, 0.7)
    got = {r.doc_id: r for r in lm_bloom.score(docs, order=order).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {k: v[0] for k, v in want.items()}
    # the filter errs upwards on a few grams in a hundred at most
    off = [abs(got[k].log_prob - s) / max(1.0, abs(s)) for k, (_, s) in want.items() if s is not None]
    assert np.mean(off) < 0.02
    stored = {r.doc_id: r.log_prob for r in lm_bloom.score(docs, lm_bloom.fit(docs, order)).collect()}
    assert all(math.isclose(stored[k], r.log_prob, rel_tol=1e-9) for k, r in got.items() if r.log_prob is not None)


def test_lm_scores_of_other_texts_and_in_many_blocks(spark, docs, texts, monkeypatch):
    some = docs.where("doc_id % 3 <> 0")
    model = lm_bloom.fit(some, 2)
    corpus = {k: words(t) for k, t in texts.items()}
    counts = [Counter(tuple(ws[i : i + n]) for k, ws in corpus.items() if k % 3 for i in range(len(ws) - n + 1)) for n in (1, 2)]
    assert (model.tokens, model.vocabulary) == (sum(counts[0].values()), len(counts[0]))
    one = {r.doc_id: r.log_prob for r in lm_bloom.score(docs, model).collect()}
    monkeypatch.setattr(lm_bloom, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(lm_bloom, "SLICE_BYTES", 20_000)
    many = {r.doc_id: r.log_prob for r in lm_bloom.score(docs, model).collect()}
    assert one.keys() == many.keys() == texts.keys()
    assert all(one[k] is many[k] or math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)


def test_registered_lm_scores_have_trigram_contexts(spark, docs):
    want = {r.doc_id: r.mean_log_prob for r in lm_bloom.score(docs, order=3).collect()}
    got = {r.doc_id: r.mean_log_prob for r in queries.op1_lm_scoring(spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or math.isclose(got[k], want[k]) for k in want)


def test_packed_arrays_and_segments():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << lm_bloom.GRAM_BITS, 5000).astype(np.uint64))
    assert (lm_bloom.unpack_sorted(lm_bloom.pack_sorted(h)) == h).all()
    seg = lm_bloom.segment_of(h, 37)
    assert (np.diff(seg) >= 0).all() and seg.min() == 0 and seg.max() == 36


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    q = rng.integers(1, 4, len(h))
    m, data = lm_bloom._segment_bits(h, q)
    t = lm_bloom.BloomTable(m, np.frombuffer(data, np.uint8))
    assert (t.levels(h) >= q).all() and (t.levels(h) > q).mean() < 0.02
    other = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    assert (t.levels(other) > 0).mean() < 0.02


# ---- 2 sharding


def test_lookup_table_against_plain_turns():
    names, slots = [f"s{i}" for i in range(7)], 101
    perms = []
    for n in names:
        o, s = (int(hashlib.md5((p + n).encode()).hexdigest()[:15], 16) for p in ("o:", "s:"))
        perms.append([(o + j * (s % (slots - 1) + 1)) % slots for j in range(slots)])
    want = [None] * slots
    while None in want:
        for i, perm in enumerate(perms):
            free = [x for x in perm if want[x] is None]
            if free:
                want[free[0]] = i
    table = maglev.lookup_table(names, slots)
    assert table.tolist() == want
    fewer = maglev.lookup_table(names[:-1], slots)
    kept = table != 6
    assert (fewer[kept] != table[kept]).mean() < 0.35
    shares = np.bincount(maglev.lookup_table(names, 10_007), minlength=7)
    assert shares.max() - shares.min() <= 1
    with pytest.raises(ValueError):
        maglev.lookup_table(names, 100)


# ---- 3 n-gram Jaccard join


def brute_pairs(texts, n=2, threshold=sketch_join.THRESHOLD):
    sets = {}
    for k, t in texts.items():
        ws = words(t)
        grams = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set())
        if grams:
            sets[k] = grams
    out = {}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            out[a, b] = both / (len(sets[a]) + len(sets[b]) - both)
    return out


def brute_links(texts):
    """doc_id: (class_id, n_links)."""
    group, links = {k: k for k in texts}, dict.fromkeys(texts, 0)

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in brute_pairs(texts):
        links[a] += 1
        links[b] += 1
        a, b = sorted((find(a), find(b)))
        group[b] = a
    return {k: (find(k), links[k]) for k in texts}


def near_links(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in sketch_join.near_links(df).collect()}


def test_near_links(docs, texts):
    want = brute_links(texts)
    assert near_links(docs) == want and sum(v[1] > 0 for v in want.values()) > 20


@pytest.mark.parametrize("block", [7, 1024])
def test_near_links_among_edited_copies(spark, monkeypatch, block):
    """Every link and class of small and large groups, in blocks of any size, with salted runs."""
    monkeypatch.setattr(sketch_join, "BLOCK", block)
    if block == 7:
        monkeypatch.setattr(sketch_join, "HOT_RUN", 3)
    rng = np.random.default_rng(5)
    rows, vocabulary = [], [f"w{i}" for i in range(30_000)]
    for g in range(60):
        base = rng.choice(vocabulary, rng.integers(4, 600))
        for _ in range(70 if g == 7 else 4):
            copy = base.copy()
            hit = rng.random(len(copy)) < rng.uniform(0, 0.1)
            copy[hit] = rng.choice(vocabulary, hit.sum())
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, rows[0][1]) for i in range(100)]
    assert near_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_links(dict(rows))


def test_a_group_that_makes_up_the_corpus(spark):
    """All parts of a large group of near copies are common, and its members still meet."""
    rng = np.random.default_rng(9)
    base = np.array([f"g{i}" for i in range(200)])
    rows = []
    for i in range(300):
        copy = base.copy()
        copy[rng.integers(0, 200, 6)] = [f"x{i}-{j}" for j in range(6)]
        rows.append((i, " ".join(copy)))
    assert near_links(spark.createDataFrame(rows, "doc_id long, text string")) == brute_links(dict(rows))


def test_passages_that_many_documents_share(spark):
    """Texts that consist of shared passages for the most part link only where the whole of them is near."""
    rng = np.random.default_rng(4)
    passages = [" ".join(f"p{p}w{i}" for i in range(60)) for p in range(6)]
    rows = []
    for i in range(250):
        own = " ".join(f"d{i}w{j}" for j in range(int(rng.integers(5, 120))))
        rows.append((i, " ".join([passages[x] for x in rng.permutation(6)[: rng.integers(1, 4)]] + [own])))
    assert near_links(spark.createDataFrame(rows, "doc_id long, text string")) == brute_links(dict(rows))


@pytest.mark.parametrize("common", [0, 0.3])
def test_no_pair_is_lost_at_any_size_of_a_band(spark, common):
    """Pairs just over the threshold stay candidates at the bottom of a band too, where sizes differ, and where many grams are common."""
    rng, rows, cases = np.random.default_rng(13), [], {}
    often = rng.integers(1, 1 << 62, 200, dtype=np.uint64)
    for size in (3, 8, 25, 60, 110, 190, 300, 460, 900, 1650):
        for ratio in (1.0, 0.8, 0.61):
            small = max(1, round(size * ratio))
            shared = math.ceil(0.6 / 1.6 * (size + small))
            if shared > small:
                continue
            sets = []
            for _ in range(30):
                pool = np.unique(np.r_[rng.choice(often, min(150, int(common * shared)), replace=False), rng.integers(1, 1 << 62, 3 * size, dtype=np.uint64)])
                pool = rng.permutation(pool)
                pool = np.r_[pool[np.isin(pool, often)], pool[~np.isin(pool, often)]]
                sets += [np.sort(pool[:size]), np.sort(np.r_[pool[:shared], pool[size : size + small - shared]])]
            offsets, flat = np.cumsum([0] + [len(x) for x in sets]), np.concatenate(sets)
            at, role, keys = sketch_join.part_keys(offsets, flat, 0.6)
            bits, first = sketch_join.bit_sketches(offsets, flat), len(rows)
            rows += [(first + i, len(x), int(((at == i) & (role == 0)).sum()), keys[at == i].view(np.int64).tolist(), bits[i]) for i, x in enumerate(sets)]
            cases[size, ratio] = {(first + i, first + i + 1) for i in range(0, len(sets), 2)}
    sk = spark.createDataFrame(rows, "node long, size int, n_own int, keys array<long>, bits binary").cache()
    comp = {r.node: r.comp for r in sketch_join.components(sketch_join.candidates(sk, 0.6)).collect()}
    lost = {k: n for k, v in cases.items() if (n := sum(a not in comp or comp[a] != comp.get(b) for a, b in v))}
    assert not lost


def test_unlike_texts_of_the_same_words_are_no_candidates(spark):
    """Bigrams that most documents share don't chain long unlike texts into a cluster."""
    rng = np.random.default_rng(23)
    rows = [(i, " ".join(f"v{w}" for w in rng.integers(0, 60, 700))) for i in range(300)]
    rows.append((300, rows[0][1] + " v1 v2"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sk = sketch_join.sketches(d, 2, 0.6).cache()
    assert sketch_join.candidates(sk, 0.6).count() == 1
    assert sum(n for _, n in near_links(d).values()) == 2


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.8, 0.9, 1.0])
def test_equal_parts_at_the_threshold(threshold):
    """Each of two sets at the threshold has as many equal parts as it counts on, where the grams that differ are spread to touch most parts."""
    for u in range(1, 80):
        both = math.ceil(threshold * u - 1e-9)
        off = {int(x) for x in np.linspace(0, u, u - both, endpoint=False)}
        for mine in (set(), off, {x for x in off if x % 2}):
            a, b = (np.array(sorted(set(range(u)) - x), np.uint64) + np.uint64(1) for x in (mine, off - mine))
            keys = [set(sketch_join.part_keys(np.array([0, len(x)]), x, threshold)[2].tolist()) for x in (a, b)]
            size = np.array([len(a), len(b)])
            assert (len(keys[0] & keys[1]) >= sketch_join.needed(size, size, np.ones(2, np.int64), threshold)).all()


def test_linked_pairs_of_sets():
    rng, sets = np.random.default_rng(17), []
    for size in rng.integers(5, 120, 100):
        base = rng.integers(1, 5_000, size).astype(np.uint64)
        for _ in range(4):
            sets.append(np.unique(base[rng.random(size) < rng.uniform(0.7, 1)]))
    sets = [sets[x] for x in rng.permutation(len(sets)) if len(sets[x])]
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j]))}
    assert set(zip(*(x.tolist() for x in sketch_join.linked(sets, None, 0.6)), strict=True)) == want and len(want) > 100
    a, b = sets[:150], sets[150:]
    assert set(zip(*(x.tolist() for x in sketch_join.linked(a, b, 0.6)), strict=True)) == {(i, j - 150) for i, j in want if i < 150 <= j}
    few = {(i, j) for i, j in want if j < 10}
    assert set(zip(*(x.tolist() for x in sketch_join.linked(sets[:10], None, 0.6)), strict=True)) == few
    assert sketch_join._roots(7, np.array([5, 4, 1]), np.array([6, 5, 2])).tolist() == [0, 1, 1, 3, 4, 4, 4]


def test_hamming_distance_bounds_the_difference():
    rng = np.random.default_rng(2)
    for size in (10, 70, 200, 1000):
        a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(1, 1 << 62, size).astype(np.uint64)]))
        x, y = sketch_join.bit_sketches(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
        off = len(set(a.tolist()) ^ set(b.tolist()))
        assert 0.3 * off < sketch_join.hamming(x, y) <= off and sketch_join.hamming(x, x) == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 21), (21, 22), (22, 20), (4, 30)]
    got = defaultdict(set)
    for r in sketch_join.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.comp].add(r.node)
    assert dict(got) == {1: {1, 2, 3, 4, 30}, 10: {10, 11}, 20: {20, 21, 22}}


# ---- 4 media columns


def plain_header(html):
    """Metadata by another parser, from the whole page."""
    found = dict.fromkeys(media.META) | {"kind": "html"}

    class Parser(HTMLParser):
        inside = False

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            found["lang"] = a["lang"].lower() if tag == "html" and "lang" in a else found["lang"]
            found["charset"] = a["charset"].lower() if tag == "meta" and "charset" in a else found["charset"]
            self.inside = tag == "title"

        def handle_endtag(self, tag):
            self.inside = False

        def handle_data(self, data):
            if self.inside:
                found["title"] = (found["title"] or "") + data

        def handle_entityref(self, name):
            self.handle_data(f"&{name};")

        def handle_charref(self, name):
            self.handle_data(f"&#{name};")

    p = Parser(convert_charrefs=False)
    p.feed(html)
    return found | {"title": found["title"] and found["title"].strip()}


def test_headers_are_read_alone(spark, tmp_path):
    """Reads stay within the headers: neither long bodies nor long members are fetched."""
    rng = np.random.default_rng(3)
    body = "".join(map(chr, rng.integers(97, 122, 200_000)))
    late = "<html><head>" + "<meta x>" * 1000 + '<meta charset="late-1"><title>Far</title></head><body>' + body
    exif = b"\xff\xd8" + (b"\xff\xe1" + (60_000).to_bytes(2, "big") + b"e" * 59_998) * 3 + b"\xff\xc2\x00\x11\x08" + (7).to_bytes(2, "big") + (9).to_bytes(2, "big") + b"z" * 100_000
    cut = exif[:70_000]
    rows = [(1, ("<html><title>t</title>" + body).encode()), (2, late.encode()), (3, exif), (4, cut), (5, b"\xff\xd8"), (6, body.encode())]
    root = "file://" + str(tmp_path / "media")
    index = media.store(spark.createDataFrame(rows, "k long, p binary"), "k", "p", root).cache()
    got = {r.raw_bytes: r for r in media.with_metadata(index, root).collect()}
    by = {k: got[len(p)] for k, p in rows}
    assert by[1].title == "t" and by[2].charset == "late-1" and by[2].title == "Far" and (by[3].height, by[3].width) == (7, 9)
    assert by[4].kind == by[5].kind == "jpeg" and by[4].width is None and by[6].kind == "text"
    assert all(r.read_bytes <= 2 * media.HEADER_BYTES for r in by.values())
    assert all(media.member_bytes(root, by[k].shard, by[k].offset, by[k].length, by[k].head) == p for k, p in rows)


def test_media_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    twice = pages.union(pages.withColumn("page_id", F.col("page_id") + 1000))
    root = "file://" + str(tmp_path / "media")
    rows = media.media_columns(twice, root=root).collect()
    html = {r.page_id: r.html for r in twice.collect()}
    assert len(rows) == len(html)
    for r in rows:
        data = media.member_bytes(root, r.shard, r.offset, r.length, r.head)
        assert hashlib.sha256(data).hexdigest() == r.digest and data.decode() == html[r.page_id] and r.raw_bytes == len(data)
        assert r.kind == "html" and r.charset == "utf-8" and f'lang="{r.lang}"' in html[r.page_id]
        assert {c: r[c] for c in media.META} == plain_header(html[r.page_id])
    members = [m.name for p in (tmp_path / "media").glob("*.tar") for m in tarfile.open(p).getmembers()]
    assert len(members) == len(set(members)) == len({r.digest for r in rows})


def test_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert media.read_header(png) | {} == media.read_header(png) and (media.read_header(png)["width"], media.read_header(png)["height"]) == (640, 480)
    assert media.read_header(b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little"))["height"] == 4
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (7).to_bytes(2, "big") + (9).to_bytes(2, "big")
    assert (media.read_header(jpeg)["height"], media.read_header(jpeg)["width"]) == (7, 9)
    assert media.read_header(b"")["kind"] == "empty" and media.read_header(b"plain")["kind"] == "text"


# ---- 5 token counts


def test_token_counts(docs, texts):
    import tiktoken

    ranks = token_count.load_ranks(token_count.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=token_count.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in token_count.count_tokens(docs).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {k: len(enc.encode_ordinary(t)) for k, t in texts.items()}
    assert all(r.n_whole <= r.n_pretokens <= r.n_tokens for r in got.values())
    whole = sorted(token_count.prove_whole(ranks))
    assert len(whole) > 40_000 and all(len(enc.encode_ordinary(w)) == 1 for w in whole[::50])
    for w in ("tokenisation", " zzqx", "ñandú"):
        assert token_count.merge_count(w.encode(), ranks) == len(enc.encode_ordinary(w))


# ---- 6 quality rules


def test_divergence_against_plain_python(docs, texts):
    refs = divergence.fit_references(docs)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    ok = {k for k, t in texts.items() if len(t) >= divergence.MIN_CHARS and len(words(t)) >= divergence.MIN_WORDS}
    mean = {}
    for k in ok:
        for w, n in Counter(words(texts[k])).items():
            mean[w] = mean.get(w, 0) + n / len(words(texts[k])) / len(ok)

    def kind(ch):
        if ch in "aeiou" or "a" <= ch <= "z":
            return "vowel" if ch in "aeiou" else "consonant"
        if ch.isalpha():
            return "upper" if ch.isupper() else "letter"
        if ch.isdigit() or ch == "\n":
            return "digit" if ch.isdigit() else "line"
        return "space" if ch.isspace() else "stop" if ch in ".,;:!?'\"()-" else "symbol"

    def classes(t):
        c = Counter(map(kind, t))
        return [c[x] / len(t) for x in divergence.CLASSES]

    def js(p, q):
        kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 1e-15)
        m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
        return math.sqrt(max(0, (kl(p, m) + kl(q, m)) / 2))

    mean_chars = np.mean([classes(texts[k]) for k in ok], axis=0)
    by_class = {}
    for name in {lang[k] for k in ok}:
        mine = [k for k in ok if lang[k] == name]
        share = Counter()
        for k in mine:
            for w, n in Counter(words(texts[k])).items():
                share[w] += n / len(words(texts[k]))
        for w, s in zip(refs.words[name], refs.shares[name], strict=False):
            assert math.isclose((share[w] + divergence.PRIOR * mean[w]) / (len(mine) + divergence.PRIOR), s, rel_tol=1e-9)
        assert refs.words[name][0] == max(share, key=lambda w: (share[w], w))
        by_class[name] = (np.sum([classes(texts[k]) for k in mine], axis=0) + divergence.PRIOR * mean_chars) / (len(mine) + divergence.PRIOR)
    for r in divergence.judge(docs, refs).collect():
        assert (r.word_distance is None) == (r.doc_id not in ok)
        if r.doc_id in ok:
            name = refs.of(lang[r.doc_id])
            c = Counter(words(texts[r.doc_id]))
            n = sum(c.values())
            p = [c[w] / n for w in refs.words[name]]
            p.append(1 - sum(p))
            q = refs.shares[name]
            assert math.isclose(r.word_distance, js(p, q), abs_tol=1e-7)
            assert math.isclose(r.char_distance, js(classes(texts[r.doc_id]), by_class[name]), abs_tol=1e-7)
            assert r.keep == (r.char_distance <= divergence.CHAR_LIMIT and r.word_distance <= divergence.WORD_LIMIT)


def test_junk_does_not_shift_the_references(spark):
    """References come from documents that are labelled good: as much junk as text changes nothing, and languages of any size are judged by one rule."""
    rng = np.random.default_rng(6)
    vocabulary = [f"word{chr(97 + i)}" for i in range(26)]
    good = [(i, " ".join(rng.choice(vocabulary, 80)), "en") for i in range(30)]
    junk = [(100 + i, "$$$ ### @@ 1234 " * 40, "en") for i in range(60)]
    one = [(300, " ".join(rng.choice(vocabulary, 80)), "yy")]
    docs = spark.createDataFrame(good + junk + one, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(g[0], 1) for g in good] + [(j[0], 0) for j in junk[:5]], "doc_id long, quality int")
    got = {r.doc_id: r for r in divergence.judge(docs, labels=labels).collect()}
    clean = {r.doc_id: r for r in divergence.judge(docs.where("doc_id < 100")).collect()}
    assert all(math.isclose(got[g[0]].word_distance, clean[g[0]].word_distance) for g in good)
    assert all(got[g[0]].keep for g in good + one) and not any(got[j[0]].keep for j in junk)
    few = divergence.fit_references(docs.where("doc_id = 300"))
    assert set(few.chars) == {"yy", divergence.ALL}


def test_long_batches_are_judged_in_parts(monkeypatch):
    rng = np.random.default_rng(31)
    rows = [" ".join(rng.choice(["some", "words", "of", "a", "text"], 2000)) if i % 3 else "#$%& " * 2000 for i in range(2000)]
    refs = divergence.References({k: np.full(9, 1 / 9) for k in ("en", divergence.ALL)}, {k: ["of"] for k in ("en", divergence.ALL)}, {k: np.array([0.2, 0.8]) for k in ("en", divergence.ALL)})
    text, lang = pa.array(rows), pa.array(["en"] * len(rows))
    _, _, cd, wd, ok = divergence.distances(text, ["en"] * len(rows), refs)
    seen, real = [], divergence.distances
    monkeypatch.setattr(divergence, "distances", lambda t, *a: seen.append(t.nbytes) or real(t, *a))
    got = divergence.kept_rows(text, lang, refs)
    assert got.tolist() == (~ok | ((cd <= divergence.CHAR_LIMIT) & (wd <= divergence.WORD_LIMIT))).tolist()
    assert max(seen) < 5 << 20 and sum(seen) > 15 << 20
    assert divergence.kept_rows(text[:0], lang[:0], refs).tolist() == []


def shuffled_bytes(spark):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_texts_without_a_good_label_are_not_moved(spark, kind):
    rng = np.random.default_rng(29)
    rows = [(i, " ".join(f"{w:x}" for w in rng.integers(0, 1 << 60, 1000)), "en") for i in [*range(300), *range(20), None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("doc_id", F.col("doc_id").cast(kind))
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)] + [(None, 1), (1000, 1)], "doc_id long, quality int").withColumn("doc_id", F.col("doc_id").cast(kind))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = shuffled_bytes(spark)
        refs = divergence.fit_references(docs.where("doc_id % 10 = 0"))
        assert shuffled_bytes(spark) - start < 1e6
        start = shuffled_bytes(spark)
        held = divergence.judge(docs, labels=labels)
        assert shuffled_bytes(spark) - start < 0.4 * sum(len(r[1]) for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rounded = lambda df: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert rounded(held) == rounded(divergence.judge(docs, refs))


def test_rules_keep_labelled_good_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    j = divergence.judge(d, labels=labels).join(labels, "doc_id").toPandas()
    assert j[j.quality == 1].keep.mean() > 0.99
    assert j[j.quality == 0].keep.mean() < 0.6


# ---- 7 language identification


def test_language_accuracy_and_priors(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 and n_chars > 60")
    got = langid.identify_documents(test, langid.fit_text(train)).join(test.select("doc_id", F.col("lang").alias("true")), "doc_id").toPandas()
    assert (got.text_lang == got.true).mean() > 0.97 and got.keep.mean() > 0.99
    ev = spark.createDataFrame([("a", "x", "en"), ("a", "x", "en"), ("b", "x", "fr"), ("c", "y", "fr")], "host string, domain string, best string")
    p = {r.host: r.prior for r in langid.host_priors(ev, ["en", "fr"]).collect()}
    k, root = langid.K, 3 / 6
    dom = (2 + k * root) / (3 + k)
    assert math.isclose(p["a"][0], (2 + k * dom) / (2 + k)) and math.isclose(sum(p["b"]), 1.0)
    assert p["a"][0] > p["b"][0] > p["c"][0]


def test_evidence_decides_short_texts(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_text(train)
    pages = [(1, "http://h.example.fr/x", '<html lang="fr"><p></p></html>'), (2, "http://h.example.com/de/1", "<html><p></p></html>"), (3, None, None), (4, "http://[bad", "<p>x</p>")]
    got = {r.page_id: r for r in langid.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert got[1].lang == "fr" and got[2].lang == "de" and got[3].keep and got[4].keep and len(got) == 4
    junk = spark.createDataFrame([(1, "qzxjv kqwxz vvqjx zzkqj xqjzv " * 20, "en", "s")], "doc_id long, text string, lang string, source string")
    assert not langid.identify_documents(junk, model).first().keep


def test_a_rare_language_keeps_its_rows(spark):
    rows = [(i, f"word number {i} of the common language", "en") for i in range(2_000)] + [(5_000, "der seltene satz", "de"), (5_001, "noch ein satz", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = langid.fit_text(docs, max_rows=20)
    assert few.langs == ["de", "en", langid.UND]
    assert (few.logp[0] == langid.fit_text(docs.where("lang = 'de'")).logp[0]).all()


def brute_language(rows, train, suffix_of):
    """key: (lang, posterior) of (key, host, domain, declared, suffix, text) rows, by plain loops."""
    width = langid.WIDTH

    def codes(text):
        k = [int(langid.TABLE[min(ord(c), 0x2FFFF)]) for c in text or ""]
        letter = [x < 58 or x >= 62 for x in k]
        return [a * width + b for a, b, x, y in zip(k, k[1:], letter, letter[1:], strict=False) if x or y], sum(letter)

    counts = defaultdict(Counter)
    for text, lang in train:
        if text is not None and lang is not None:
            c, _ = codes(text)
            for x, n in Counter(c).items():
                counts[lang.lower()][x] += n / (1 + len(c) / langid.SATURATION)
    langs = sorted(k for k, c in counts.items() if c)
    total = {k: sum(round(x, 6) for x in counts[k].values()) + 0.01 * width * width for k in langs}
    logp = {k: (lambda x, k=k: math.log((0.01 + round(counts[k][x], 6)) / total[k])) for k in langs} | {langid.UND: lambda x: -math.log(4096)}
    names = [*langs, langid.UND]
    like, letters, best = {}, {}, {}
    for key, *_, text in rows:
        c, letters[key] = codes(text)
        n, t = len(c), Counter(c)
        like[key] = [sum(m * logp[x](y) for y, m in t.items()) / n * (langid.EVIDENCE * n / (langid.EVIDENCE + n)) if n else 0.0 for x in names]
        best[key] = names[int(np.argmax(like[key]))] if letters[key] else None
    host_n, dom_n, all_n = defaultdict(Counter), defaultdict(Counter), Counter()
    for key, host, domain, *_ in rows:
        if best[key]:
            host_n[host, domain][best[key]] += 1
            dom_n[domain][best[key]] += 1
            all_n[best[key]] += 1
    out, k = {}, langid.K
    for key, host, domain, declared, suffix, _ in rows:
        score = []
        for i, x in enumerate(names):
            p = (all_n[x] + 1) / (sum(all_n.values()) + len(names))
            p = (dom_n[domain][x] + k * p) / (sum(dom_n[domain].values()) + k)
            p = (host_n[host, domain][x] + k * p) / (sum(host_n[host, domain].values()) + k)
            s = like[key][i] + math.log(p)
            for said, sure in ((declared, langid.P_DECLARED), (suffix, langid.P_SUFFIX)):
                if said in langs:
                    s += math.log(sure if said == x else (1 - sure) / (len(names) - 1))
            score.append(-1e9 if x == langid.UND and not letters[key] else s)
        e = np.exp(np.array(score) - max(score))
        out[key] = (names[int(np.argmax(score))], float(max(e / e.sum())))
    return out


def test_language_queries_against_brute_force(spark, docs):
    rows = docs.collect()
    train = [(r.text, r.lang) for r in rows]
    want = brute_language([(r.doc_id, r.source, None, r.lang.lower(), None, r.text) for r in rows], train, None)
    got = {r.doc_id: r for r in queries.op7_language_id(spark, SF).collect()}
    assert {k: r.lang for k, r in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(math.isclose(got[k].posterior, v[1], rel_tol=1e-6) for k, v in want.items())
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = brute_language([(r.page_id, *langid.page_parts(r.url, r.html)) for r in pages], train, None)
    got = {r.page_id: r for r in queries.op7_language_id_pages(spark, SF).collect()}
    assert {k: r.lang for k, r in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(math.isclose(got[k].posterior, v[1], rel_tol=1e-6) for k, v in want.items())


def test_scripts_beyond_latin(spark):
    """Languages of one script are told apart by its letters."""
    rng, rows, ranges = np.random.default_rng(8), [], {"el": (0x3B1, 24), "ru": (0x430, 32), "uk": (0x430, 32), "ar": (0x627, 30), "zh": (0x4E00, 900), "ko": (0xAC00, 900)}
    for name, (base, n) in ranges.items():
        p = np.random.default_rng(len(name) + sum(map(ord, name))).dirichlet(np.full(n, 0.3))
        for _ in range(30):
            rows.append((len(rows), " ".join("".join(chr(base + i) for i in rng.choice(n, 5, p=p)) for _ in range(30)), name, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit_text(docs.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.text_lang for r in langid.identify_documents(docs.where("doc_id % 2 = 1").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")), model).collect()}
    assert all(got[r[0]] == r[2] for r in rows if r[0] % 2)


def test_identified_languages_are_handed_on(spark):
    """Rows that are declared wrong leave the stage with their own language, and are judged by it."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 400")
    wrong = d.withColumn("lang", F.when((F.col("lang") == "fr") & (F.col("doc_id") % 10 == 1), "en").otherwise(F.col("lang")))
    out = langid.keep_known(wrong)
    assert out.columns == d.columns
    back = out.join(d.select("doc_id", F.col("lang").alias("meant")), "doc_id").where("meant = 'fr' and doc_id % 10 = 1")
    assert back.count() > 3 and back.where("lang = 'fr'").count() > 0.9 * back.count()


def test_page_parts():
    assert langid.page_parts("http://a.b.example.org/fr/1", '<html lang="FR-ca"><script>x</script><p>hi &amp; ho</p>')[:4] == ("a.b.example.org", "example.org", "fr", "fr")
    assert urlparse("http://a").hostname == langid.page_parts("http://a", None)[0]


# ---- 8 mixing


def brute_schedule(rows, block, weights=None, slots=None):
    tokens = defaultdict(int)
    for doc, text, source in rows:
        tokens[source, doc] += len((text or "").split())
    held = defaultdict(list)
    for source in sorted({s for s, _ in tokens}):
        ids = sorted((d for s, d in tokens if s == source), key=lambda d: (int(hashlib.md5(f"{mixing.SEED}:{source}:{d}".encode()).hexdigest()[:15], 16), d))
        total, at = sum(tokens[source, d] for d in ids), 0
        n = max(1, -(-total // block))
        held[source] = [[] for _ in range(n)]
        for d in ids:
            held[source][min(at // block, n - 1)].append(d)
            at += tokens[source, d]
    if weights:
        w = {s: int(weights[s] / sum(weights.values()) * 10**15) for s in held}
    else:
        raw = {s: max(1, int(sum(tokens[s, d] for b in held[s] for d in b) ** mixing.TEMPERATURE * 100)) for s in held}
        q = sum(len(b) + mixing.SPARE for b in held.values())
        w = {s: raw[s] * q + (len(held[s]) + mixing.SPARE) * sum(raw.values()) for s in held}
    total = sum(w.values())
    if slots is None:
        slots = max(-(-(len(held[s]) + mixing.SPARE) * total // w[s]) for s in held)
        assert weights or slots <= 2 * sum(len(b) + mixing.SPARE for b in held.values())
    out, rank = [], Counter()
    for i in range(slots):
        u, lo = (i + 1) * mixing.PHI48 % 2**48, 0
        for s in sorted(held):
            hi = lo + w[s]
            if lo * 2**48 // total <= u < hi * 2**48 // total:
                out += [(i, s, rank[s] // len(held[s]), rank[s] % len(held[s]), d) for d in held[s][rank[s] % len(held[s])]]
                rank[s] += 1
            lo = hi
    return sorted(out)


def test_schedule_against_plain_python(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = sorted((r.slot, r.source, r.epoch, r.block, r.doc_id) for r in mixing.schedule(docs, block_tokens=512).collect())
    assert got == brute_schedule(rows, 512)
    assert {g[4] for g in got} == {r[0] for r in rows}
    weights = {f"src{i}": 1.0 + i for i in range(5)}
    some = docs.where(F.col("source").isin(*weights))
    got = sorted((r.slot, r.source, r.epoch, r.block, r.doc_id) for r in mixing.schedule(some, weights, 512, slots=300).collect())
    assert got == brute_schedule([r for r in rows if r[2] in weights], 512, weights, 300)


def test_slots_are_ranked_in_ranges(docs, monkeypatch):
    want = sorted(map(repr, mixing.schedule(docs, block_tokens=512).collect()))
    monkeypatch.setattr(mixing, "RANK_SLOTS", 7)
    assert sorted(map(repr, mixing.schedule(docs, block_tokens=512).collect())) == want


def test_weights_that_would_lose_a_source(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y"), (3, "d", None)], "doc_id long, text string, source string")
    for weights in ({"x": 1.0, "y": 1.0}, {"x": 1.0, "y": -1.0, None: 1.0}, {"x": 1.0, "y": 1e-16, None: 1.0}):
        with pytest.raises(ValueError):
            mixing.schedule(d, weights)
    assert {r.source for r in mixing.schedule(d, {"x": 1.0, "y": 0.0, None: 2.0}).collect()} == {"x", None}


def test_weights_of_very_large_sources(spark):
    """Tokens of a petabyte fit the arithmetic."""
    held = spark.createDataFrame([("a", 10**15), ("b", 7), ("c", 3 * 10**14)], "source string, n_tokens long")
    w = {r.source: int(r.w) for r in mixing.targets(spark, held, None).collect()}
    blocks = {"a": -(-(10**15) // 8192), "b": 1, "c": -(-3 * 10**14 // 8192)}
    raw = {k: max(1, int(n**mixing.TEMPERATURE * 100)) for k, n in (("a", 1e15), ("b", 7.0), ("c", 3e14))}
    assert w == {k: raw[k] * sum(b + mixing.SPARE for b in blocks.values()) + (blocks[k] + mixing.SPARE) * sum(raw.values()) for k in w}


def test_slots_follow_the_weights(spark):
    rows = [(i, "ten words " * 5, f"src{i % 5}") for i in range(400)]
    weights = {f"src{i}": 1.0 + i for i in range(5)}
    plan = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, 50, slots=300).collect()
    shares = Counter(s for s, _ in {(r.source, r.slot) for r in plan})
    assert sum(shares.values()) == 300 and all(abs(shares[s] - 300 * w / 15) <= 2 for s, w in weights.items())


def test_mix_order_and_rows(docs):
    plan = mixing.schedule(docs, block_tokens=512)
    assert mixing.mix(docs, block_tokens=512).count() == plan.count()
    assert mixing.mix(docs, block_tokens=512).columns == docs.columns


# ---- 9 quality classifier


def test_classifier_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    vectors = classifier.word_vectors(d)
    model = classifier.fit(d, labels, classifier.pooled(d, vectors).cache(), vectors)
    assert model.report["accuracy"] > 0.93 and model.report["temperature"] > 0
    got = classifier.classify(d, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.98


def test_context_sums_against_plain_python():
    t = Tokens(pa.array(["a b c a", "b", "c a"]), trim=False)
    place, sign = classifier.index_vectors()
    b = classifier.buckets_of(t)
    want = np.zeros((classifier.BUCKETS, classifier.DIM))
    for lo, hi in zip(t.offsets, t.offsets[1:], strict=False):
        for i in range(lo, hi):
            for j in range(max(lo, i - classifier.WINDOW), min(hi, i + classifier.WINDOW + 1)):
                if i != j:
                    np.add.at(want[b[i]], place[b[j]], sign[b[j]])
    used, sums = classifier.context_sums(t, place, sign)
    assert np.allclose(sums, want[used]) and set(used) == set(b)


def test_classifier_query_against_brute_force(spark, docs, texts):
    """The registered query by plain loops over tokens: word vectors, pools, the same fit on the same labels, probabilities."""
    place, sign = classifier.index_vectors()
    tokens = {k: (t or "").lower().split() for k, t in texts.items()}
    bucket = {w: int(classifier.buckets_of(Tokens(pa.array([w]), trim=False))[0]) for ws in tokens.values() for w in set(ws)}
    vectors = defaultdict(lambda: np.zeros(classifier.DIM))
    for ws in tokens.values():
        for i, w in enumerate(ws):
            for j in range(max(0, i - classifier.WINDOW), min(len(ws), i + classifier.WINDOW + 1)):
                if i != j:
                    y = bucket[ws[j]]
                    np.add.at(vectors[bucket[w]], place[y], sign[y])
    vectors = {k: v / np.linalg.norm(v) for k, v in vectors.items() if v.any()}
    mean = np.mean(list(vectors.values()), axis=0)
    vectors = {k: (v - mean) / np.linalg.norm(v - mean) for k, v in vectors.items()}
    zero = np.zeros(classifier.DIM)
    pools = {k: sum((vectors.get(bucket[w], zero) for w in ws), zero) / max(1, len(ws)) for k, ws in tokens.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = sorted(set(labels) & set(pools))
    held = np.array([int(classifier.mix64(classifier.hash_words([str(i)]))[0]) % 1000 < 200 for i in ids])
    net = classifier.fit_network(np.array([pools[i] for i in ids]), np.array([float(labels[i]) for i in ids]), held)
    got = {r.doc_id: r for r in queries.op9_quality_classifier(spark, SF).collect()}
    assert got.keys() == pools.keys()
    for k, v in pools.items():
        p = float(net.probability(v[None, :])[0])
        assert abs(got[k].quality_prob - p) < 1e-3 and (got[k].keep == (p >= classifier.KEEP) or abs(p - classifier.KEEP) < 1e-3)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, classifier.DIM))
    p = 1 / (1 + np.exp(-(2 * np.tanh(x[:, 0]) - 2 * x[:, 1] + x[:, 2])))
    y = (rng.random(3000) < p).astype(float)
    held = np.arange(3000) % 4 == 0
    net = classifier.fit_network(x, y, held)
    q = net.probability(x[held])
    assert ((q > 0.5) == (p[held] > 0.5)).mean() > 0.75
    for lo in (0.0, 0.5):
        pick = (q >= lo) & (q < lo + 0.5)
        assert abs(q[pick].mean() - y[held][pick].mean()) < 0.08


# ---- 10 packing


def check_packing(rows, lengths, capacity):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc, n in lengths.items():
        assert sum(r.length for r in by_doc[doc]) == n
        assert sorted(r.piece for r in by_doc[doc]) == list(range(max(1, -(-n // capacity))))
    bins = defaultdict(list)
    for r in rows:
        if r.length:
            bins[r.sequence].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, texts, capacity):
    lengths = {k: len(t.split()) for k, t in texts.items()}
    n = check_packing(packing.pack(docs, capacity).collect(), lengths, capacity)
    parts = [p for x in lengths.values() for p in ([capacity] * (x // capacity) + ([x % capacity] if x % capacity else []))]
    # rounding up costs one group of large pieces at most
    large = sum(p > packing.SMALL * capacity for p in parts)
    assert -(-sum(parts) // capacity) <= n <= best_fit_decreasing(parts, capacity) + -(-large // packing.GROUPS) + packing.GROUPS


def test_plan_against_direct_best_fit_of_small_ones():
    rng = np.random.default_rng(3)
    for _ in range(30):
        hist = Counter(int(x) for x in rng.integers(1, 33, rng.integers(1, 200)))
        plan = packing.plan_sequences(hist, 64, 4, 1 / 2)
        fill, count = defaultdict(int), Counter()
        for length, _, n, first, offset in plan:
            count[length] += n
            for s in range(first, first + n):
                assert fill[s] == offset
                fill[s] += length
        assert count == hist and max(fill.values()) <= 64
        assert len(fill) <= best_fit_decreasing(list(hist.elements()), 64) + 1
