"""Language identification by Bayesian evidence fusion.

log P(l | row) ~ text likelihood + declared markup language + address suffix + host prior. The text model is a character-bigram
model, fitted on a bounded sample of rows with a declared language (MAX_ROWS). Host priors are Dirichlet-smoothed from host to
domain to the whole table: p_host = (n_host + K p_domain) / (N_host + K), over grouped counts of the rows' likeliest
languages by text. An extra class "und", under which every bigram has the chance 1 / 4096, stands for text of no language. Letters of
all scripts count: those from Greek to Arabic singly, others by Unicode block; a row's weight in the text model is n / (1 + n / SATURATION) for n bigrams.

Defined results: null or blank text leaves the other evidence to decide; a missing declaration or suffix is no evidence; a null
host is a host of its own; ties go to the first language by name; text is read whole; repeated rows each count and get their row; an empty
table gives an empty result; without any fitted language all rows are "und"; other columns are ignored. A row is rejected when
its text has MIN_LETTERS letters or more and "und" or no language with a posterior of MIN_POSTERIOR wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, free_name, materialize, sized

WIDTH = 256
#: Bigrams of one row from which on more of them add little.
SATURATION = 2000
MAX_ROWS = 20_000
#: Bigrams of a text are dependent: their total weighs as at most this many.
EVIDENCE = 150.0
P_DECLARED, P_SUFFIX, K = 0.85, 0.75, 12.0
MIN_LETTERS, MIN_POSTERIOR = 20, 0.5
UND = "und"
SUFFIX = {"fr": "fr", "be": "fr", "de": "de", "at": "de", "ch": "de", "es": "es", "mx": "es", "ar": "es", "cl": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "en": "en"}


def _table() -> np.ndarray:
    """Classes of code points: a-z, single accented letters, blank, digit, sentence mark, other Latin letter, other; 64 to 223 letters of the alphabets
    from Greek to Arabic, one each but for rare ones; 224 to 255 blocks of 256 further code points."""
    out = np.full(0x30000, 61, np.uint8)
    accents = "àâäçèéêëîïôöùûüÿœæßáíóúñìòåøãõ"
    for c in range(0x30000):
        ch = chr(c).lower()[0]
        if "a" <= ch <= "z":
            out[c] = ord(ch) - 97
        elif ch in accents:
            out[c] = 26 + accents.index(ch)
        elif ch.isspace():
            out[c] = 58
        elif ch.isdigit():
            out[c] = 59
        elif ch in ".,;:!?'\"-()":
            out[c] = 60
        elif ch.isalpha():
            low = ord(ch)
            out[c] = 62 if low < 0x370 else 64 + low % 160 if low < 0x700 else 224 + (low >> 8) % 32
    return out


TABLE = _table()


def bigrams(text: str | None) -> tuple[np.ndarray, int]:
    """(class-bigram codes that touch a letter, number of letters) of a text."""
    if not text:
        return np.zeros(0, np.int64), 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = TABLE[np.minimum(codes, 0x2FFFF)].astype(np.int64)
    letter = (k < 58) | (k >= 62)
    pair = letter[:-1] | letter[1:]
    return (k[:-1] * WIDTH + k[1:])[pair], int(letter.sum())


class TextModel:
    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp

    def likelihoods(self, text: str | None) -> tuple[np.ndarray, int]:
        """Tempered log likelihoods per language and UND, and the number of letters."""
        codes, letters = bigrams(text)
        if not len(codes):
            return np.zeros(len(self.langs)), 0
        n = len(codes)
        if n < 400:
            total = self.logp[:, codes].sum(1)
        else:
            used, k = np.unique(codes.astype(np.uint16), return_counts=True)
            total = self.logp[:, used] @ k
        return total / n * (EVIDENCE * n / (EVIDENCE + n)), letters


def fit_text(docs: DataFrame, max_rows: int = MAX_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> TextModel:
    """Bigram models from about `max_rows` rows of each declared language, picked by the hash of their key; of a rarer language all rows."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.lower(F.col(lang).cast("string")).alias("lang"), F.col(text).alias("text"))
    steps = {r["lang"]: math.ceil(r["count"] / max_rows) for r in rows.groupBy("lang").count().collect() if r["count"] > max_rows}
    step = F.lit(1)
    if steps:
        step = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(steps.items()) for x in pair])[F.col("lang")], step)
    rows = rows.where(F.pmod(F.xxhash64("k"), step) == 0).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes, _ = bigrams(t)
                if len(codes):
                    part = np.bincount(codes, minlength=WIDTH * WIDTH) / (1 + len(codes) / SATURATION)
                    sums[name] = sums.get(name, 0) + part
        for name, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "code", "n"])

    got = rows.mapInArrow(run, "lang string, code int, n double").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs, logs = [], []
    for name, part in sorted(got.groupby("lang")):
        v = np.full(WIDTH * WIDTH, 0.01)
        v[part.code.to_numpy()] += np.round(part.n.to_numpy(), 6)
        langs.append(name)
        logs.append(np.log(v / v.sum()))
    langs.append(UND)
    logs.append(np.full(WIDTH * WIDTH, -math.log(4096)))
    return TextModel(langs, np.array(logs))


_HTML_LANG = re.compile(r"""<html[^>]*\blang=["']?([A-Za-z]+)""", re.I)
_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.I | re.S)


def page_parts(url: str | None, html: str | None) -> tuple[str | None, str | None, str | None, str | None, str]:
    """(host, domain, declared language, suffix language, text) of a web page."""
    host = suffix = domain = None
    if url:
        try:
            parts = urlsplit(url)
            host = parts.hostname
        except ValueError:
            parts = None
        if host:
            labels = host.split(".")
            domain = ".".join(labels[-2:])
            suffix = SUFFIX.get(labels[-1])
            first = parts.path.strip("/").split("/")[0].lower()
            if suffix is None and len(first) == 2:
                suffix = SUFFIX.get(first)
    declared = None
    if html and (m := _HTML_LANG.search(html)):
        declared = m[1].lower()
    return host, domain, declared, suffix, _DROP.sub(" ", html or "")


def _evidence(docs: DataFrame, columns: list[str], parts, model: TextModel, kind: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in arrow_batches(batches):
            key, *rest = (b.column(i).to_pylist() for i in range(b.num_columns))
            rows = [parts(*r) for r in zip(*rest, strict=True)]
            ll = [m.likelihoods(r[4]) for r in rows]
            like = np.array([x[0] for x in ll]).reshape(len(rows), len(m.langs))
            best = [m.langs[i] if n else None for i, (_, n) in zip(like.argmax(1), ll, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(4)), pa.array([x[1] for x in ll], pa.int64()), pa.array(best, pa.string()), pa.array(list(like), pa.list_(pa.float64()))],
                ["key", "host", "domain", "declared", "suffix", "letters", "best", "like"],
            )

    return docs.select(*columns).mapInArrow(run, f"key {kind}, host string, domain string, declared string, suffix string, letters long, best string, like array<double>")


def host_priors(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """(host, domain, prior): hierarchically smoothed shares per host, from one grouped count."""
    cols = [F.count_if(F.col("best") == x).alias(f"n{i}") for i, x in enumerate(langs)]
    counts = evidence.groupBy("host", "domain").agg(*cols)
    n = F.array(*[F.col(f"n{i}").cast("double") for i in range(len(langs))])
    counts = materialize(counts.select("host", "domain", n.alias("n")), "hostcounts")
    top = counts.select(*[F.sum(F.col("n")[i]).alias(f"t{i}") for i in range(len(langs))]).first()
    total = sum(x or 0 for x in top)
    share = [((x or 0) + 1.0) / (total + len(langs)) for x in top]
    per_domain = counts.groupBy("domain").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(len(langs))]).alias("d"))
    p_domain = F.zip_with("d", F.array(*map(F.lit, share)), lambda x, p: (x + K * p) / (F.aggregate("d", F.lit(0.0), lambda a, y: a + y) + K))
    per_domain = per_domain.select(F.col("domain").alias("dom"), p_domain.alias("pd"))
    joined = counts.join(per_domain, F.col("domain").eqNullSafe(F.col("dom")))
    prior = F.zip_with("n", "pd", lambda x, p: (x + K * p) / (F.aggregate("n", F.lit(0.0), lambda a, y: a + y) + K))
    return joined.select("host", "domain", prior.alias("prior"))


def fuse(evidence: DataFrame, model: TextModel, kind: str) -> DataFrame:
    """(key, lang, posterior, text_lang, declared, suffix, host, keep)."""
    evidence = materialize(evidence, "langevidence")
    langs = model.langs
    priors = sized(materialize(host_priors(evidence, langs), "priors"), 120).select(F.col("host").alias("h2"), F.col("domain").alias("d2"), "prior")
    both = evidence.join(priors, F.col("host").eqNullSafe(F.col("h2")) & F.col("domain").eqNullSafe(F.col("d2")))
    place = {x: i for i, x in enumerate(langs)}

    def pull(values: list[str | None], p: float) -> np.ndarray:
        out = np.zeros((len(values), len(langs)))
        if len(langs) > 2:
            for r, v in enumerate(values):
                if (i := place.get(v)) is not None and v != UND:
                    out[r] = math.log((1 - p) / (len(langs) - 1))
                    out[r, i] = math.log(p)
        return out

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            declared, suffix = b.column(3).to_pylist(), b.column(4).to_pylist()
            like = np.array(b.column(7).to_pylist()).reshape(b.num_rows, len(langs))
            letters = b.column(5).to_numpy()
            score = like + pull(declared, P_DECLARED) + pull(suffix, P_SUFFIX) + np.log(np.array(b.column(8).to_pylist()))
            score[letters == 0, place[UND]] = -1e9 if len(langs) > 1 else 0.0
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            at = p.argmax(1)
            keep = (letters < MIN_LETTERS) | ((at != place[UND]) & (p.max(1) >= MIN_POSTERIOR))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([langs[i] for i in at], pa.string()), pa.array(p.max(1)), b.column(6), b.column(3), b.column(4), b.column(1), pa.array(keep)],
                ["key", "lang", "posterior", "text_lang", "declared", "suffix", "host", "keep"],
            )

    both = both.select("key", "host", "domain", "declared", "suffix", "letters", "best", "like", "prior")
    return both.mapInArrow(run, f"key {kind}, lang string, posterior double, text_lang string, declared string, suffix string, host string, keep boolean")


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Languages of web pages: key page_id."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return fuse(_evidence(pages, ["page_id", "url", "html"], page_parts, model, kind), model, kind).withColumnRenamed("key", "page_id")


def document_parts(source, declared, text):
    """Documents have a source for a host and their lang column for a declaration."""
    return source, None, declared.lower() if declared else None, None, text


def identify_documents(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """Languages of documents: key doc_id."""
    model = model or fit_text(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string").alias("lang"), "text")
    return fuse(_evidence(plain, ["doc_id", "source", "lang", "text"], document_parts, model, kind), model, kind).withColumnRenamed("key", "doc_id")


def keep_known(docs: DataFrame) -> DataFrame:
    """`docs` without the documents of no known language, and with `lang` as identified where that differs from the declared one. A doc_id goes when all
    its rows are rejected, and has the language of its surest row; rows of null doc_id stay as they are."""
    found = identify_documents(docs)
    per = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("keep").alias("keep"), F.max(F.when(F.col("keep") & (F.col("lang") != UND), F.struct("posterior", "lang")))["lang"].alias("now"), F.max("declared").alias("was"), F.min("declared").alias("was_too"))
    per = per.where("not keep or (now is not null and (was is null or now <> was or was <> was_too))")
    key, keep, now = (free_name(docs, x) for x in ("rejected", "keep", "now"))
    news = sized(materialize(per.select(F.col("doc_id").alias(key), F.col("keep").alias(keep), F.col("now").alias(now)), "langnews"), 40)
    both = docs.join(news, docs["doc_id"] == news[key], "left").where(F.coalesce(F.col(keep), F.lit(True)))
    return both.select(*[F.coalesce(F.col(now), docs["lang"]).alias(c) if c == "lang" else docs[c] for c in docs.columns])
