"""Quality rules by distribution divergence.

A document's character-class histogram and its histogram over the language's common words are compared with
the language's references by Jensen-Shannon distance (base 2, 0 to 1). References are means of the documents' own distributions, over
documents of the language that pass the length guards: those labelled good where there are labels, else all. Each language's means are
smoothed by PRIOR documents of the mean of all languages, whatever its size; common words are the COMMON_WORDS of the largest mean share, among those of WORD_SHARE or more. A document is
rejected if it is long enough to be judged and either distance is over its limit.

Defined results: null, empty or short text is not judged (null distances) and kept; text is read whole; repeated rows weigh
as often as they occur and each get their row; a null language is a language of its own; a language without reference documents
is compared with the mean of all, and without any reference nothing is judged; an empty table gives an empty result; other columns are ignored, and the
filter keeps the input's columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tokens, arrow_batches, discard, free_name, materialize

CLASSES = ["vowel", "consonant", "upper", "letter", "digit", "space", "line", "stop", "symbol"]
MIN_CHARS, MIN_WORDS = 200, 40
#: Documents that the mean of all languages weighs in each language's references.
PRIOR = 2.0
COMMON_WORDS, WORD_SHARE = 40, 0.002
CHAR_LIMIT, WORD_LIMIT = 0.25, 0.36
ALL = "\0all"
#: Bits of the map of labelled ids for each of them, and the power of two that it has at most (32 MB).
ID_BITS, MOST_BITS = 16, 28


def _class_table() -> np.ndarray:
    out = np.full(0x3000, CLASSES.index("symbol"), np.int8)
    for c in range(0x3000):
        ch = chr(c)
        if ch in "aeiou":
            k = "vowel"
        elif "a" <= ch <= "z":
            k = "consonant"
        elif ch.isalpha():
            k = "upper" if ch.isupper() else "letter"
        elif ch.isdigit():
            k = "digit"
        elif ch == "\n":
            k = "line"
        elif ch.isspace():
            k = "space"
        elif ch in ".,;:!?'\"()-":
            k = "stop"
        else:
            continue
        out[c] = CLASSES.index(k)
    return out


TABLE = _class_table()


def char_counts(texts: list[str | None]) -> np.ndarray:
    """(rows, classes) counts; letters beyond the table count as letters."""
    out = np.zeros((len(texts), len(CLASSES)))
    for i, t in enumerate(texts):
        if t:
            codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            k = TABLE[np.minimum(codes, 0x2FFF)]
            k = np.where(codes >= 0x3000, CLASSES.index("letter"), k) if codes.max() >= 0x3000 else k
            out[i] = np.bincount(k, minlength=len(CLASSES))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance of distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _langs(column: pa.Array) -> list[str]:
    return ["\0null" if x is None else str(x) for x in column.to_pylist()]


def _word_counts(t: Tokens, words: dict[str, int], rows: np.ndarray) -> np.ndarray:
    """(rows, words + 1) counts of the given rows; the last column is every other word."""
    place = np.fromiter((words.get(w, len(words)) for w in t.words), np.int64, len(t.words))
    at = np.full(len(t.lengths), -1)
    at[rows] = np.arange(len(rows))
    r = at[t.rows]
    pick = r >= 0
    flat = np.bincount(r[pick] * (len(words) + 1) + place[t.ids[pick]], minlength=len(rows) * (len(words) + 1))
    return flat.reshape(len(rows), len(words) + 1).astype(float)


class References:
    """Per language: the mean character distribution, the common words and their mean distribution."""

    def __init__(self, chars: dict[str, np.ndarray], words: dict[str, list[str]], shares: dict[str, np.ndarray]):
        self.chars, self.words, self.shares = chars, words, shares

    def of(self, lang: str) -> str:
        return lang if lang in self.chars else ALL


def _judged(chars: np.ndarray, t: Tokens) -> np.ndarray:
    return (chars.sum(1) >= MIN_CHARS) & (t.lengths >= MIN_WORDS)


def fit_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """Two passes over all documents: class means with candidates for common words, then the candidates' exact mean shares."""
    base = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    schema = "lang string, item string, total double"

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64()))], ["lang", "item", "total"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], float] = {}
        for b in arrow_batches(batches):
            texts, langs, t = b.column(1).to_pylist(), _langs(b.column(0)), Tokens(b.column(1))
            chars = char_counts(texts)
            ok = _judged(chars, t)
            names = np.array(langs, dtype=object)
            for name in sorted(set(names[ok])):
                rows = np.flatnonzero(ok & (names == name))
                p = (chars[rows] / chars[rows].sum(1, keepdims=True)).sum(0)
                for key, v in zip([*("c:" + c for c in CLASSES), "n:"], [*p, len(rows)], strict=True):
                    sums[name, key] = sums.get((name, key), 0.0) + float(v)
                pick = np.isin(t.rows, rows)
                mean = np.bincount(t.ids[pick], weights=1 / t.lengths[t.rows[pick]], minlength=len(t.words)) / len(rows)
                # a word over the share in the corpus is over it in some batch
                for i in np.flatnonzero(mean >= WORD_SHARE):
                    sums[name, "w:" + t.words[i]] = 0.0
        yield emit([(*k, v) for k, v in sums.items()])

    got = base.mapInArrow(first, schema).groupBy("lang", "item").agg(F.sum("total").alias("total")).toPandas()
    chars, counts, candidates = {}, {}, {}
    for name, part in got.groupby("lang"):
        v = dict(zip(part["item"], part.total, strict=True))
        counts[name] = v["n:"]
        chars[name] = np.array([v["c:" + c] for c in CLASSES])
        candidates[name] = sorted(k[2:] for k in v if k.startswith("w:"))
    # every language also counts the others' candidates, for the mean of all
    every = sorted({w for ws in candidates.values() for w in ws})
    held = docs.sparkSession.sparkContext.broadcast({k: {w: i for i, w in enumerate(every)} for k in candidates})

    def second(batches):
        sums: dict[str, np.ndarray] = {}
        for b in arrow_batches(batches):
            texts, langs, t = b.column(1).to_pylist(), _langs(b.column(0)), Tokens(b.column(1))
            n_chars = np.array([len(x or "") for x in texts])
            ok = (n_chars >= MIN_CHARS) & (t.lengths >= MIN_WORDS)
            names = np.array(langs, dtype=object)
            for name in sorted(set(names[ok])):
                rows = np.flatnonzero(ok & (names == name))
                part = (_word_counts(t, held.value[name], rows) / t.lengths[rows][:, None]).sum(0)
                sums[name] = sums.get(name, 0) + part
        rows = []
        for name, part in sums.items():
            rows += [(name, w, float(part[i])) for w, i in held.value[name].items()]
        yield emit(rows)

    got = base.mapInArrow(second, schema).groupBy("lang", "item").agg(F.sum("total").alias("total")).toPandas()
    shares_of = {name: dict(zip(p["item"], p.total, strict=True)) for name, p in got.groupby("lang")}
    total = sum(counts.values())
    if not total:
        return References({}, {}, {})
    mean_chars = sum(chars.values()) / total
    mean_words = {w: sum(v.get(w, 0.0) for v in shares_of.values()) / total for w in every}
    out_chars, words, shares = {}, {}, {}
    for name in [*counts, ALL]:
        n = 0.0 if name == ALL else counts[name]
        v = {} if name == ALL else shares_of.get(name, {})
        share = {w: (v.get(w, 0.0) + PRIOR * mean_words[w]) / (n + PRIOR) for w in every}
        words[name] = sorted((w for w in every if round(share[w], 9) >= WORD_SHARE), key=lambda w: (-round(share[w], 9), w))[:COMMON_WORDS]
        known = np.array([share[w] for w in words[name]])
        shares[name] = np.append(known, max(0.0, 1 - known.sum()))
        c = (0 if name == ALL else chars[name]) + PRIOR * mean_chars
        out_chars[name] = c / c.sum()
    return References(out_chars, words, shares)


def may_be_among(docs: DataFrame, ids: DataFrame) -> Column:
    """Whether a row's doc_id may be one of `ids` (stored, of docs' type): always if it is, else for one in ID_BITS or, where these exceed MOST_BITS, more."""
    bits = 1 << min(MOST_BITS, max(20, (ID_BITS * ids.count() - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))

    def build(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            p = np.sort(b.column(0).to_numpy())
            for part in np.split(p, np.flatnonzero(np.diff(p >> 20)) + 1):
                if len(part):
                    held.setdefault(int(part[0] >> 20), np.zeros(1 << 20, bool))[part & 0xFFFFF] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["slice", "data"])

    found = ids.select(place(ids.columns[0]).alias("p")).repartition(F.shiftright("p", 20)).mapInArrow(build, "slice long, data binary").collect()
    table = np.zeros(bits // 8, np.uint8)
    for r in found:
        table[r.slice << 17 : (r.slice + 1) << 17] = np.frombuffer(r.data, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def among(place: pa.Array) -> pa.Array:
        p = place.to_numpy(zero_copy_only=False)
        return pa.array((held.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    return among(place(docs["doc_id"]))


def good_documents(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The documents that `labels` call good, all of them, stored with their language and text; `docs` itself without labels or where none of them is labelled good.

    A bitmap of the labelled ids goes first, so that the join, which is exact, moves hardly any other text."""
    if labels is None:
        return docs
    mark = free_name(docs, "good")
    ids = materialize(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias(mark)).distinct(), "goodids")
    kind = docs.schema["doc_id"].dataType
    some = docs.where(may_be_among(docs, ids)) if kind == ids.schema[mark].dataType and kind.simpleString() in ("bigint", "int", "string") else docs
    # the same join at all sizes: what a broadcast saves here is little, and it ends where the ids no longer fit
    good = materialize(some.join(ids.hint("merge"), some["doc_id"] == ids[mark], "left_semi").select("lang", "text"), "good")
    discard(ids)
    if good.isEmpty():
        discard(good)
        return docs
    return good


def fit_good(docs: DataFrame, labels: DataFrame | None) -> References:
    good = good_documents(docs, labels)
    refs = fit_references(good)
    if good is not docs:
        discard(good)
    return refs


def distances(texts: pa.Array, langs: list[str], refs: References) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chars, words, character distance, word distance, judged) of a batch."""
    t, chars = Tokens(texts), char_counts(texts.to_pylist())
    ok = _judged(chars, t) & bool(refs.chars)
    char_d, word_d = np.zeros(len(langs)), np.zeros(len(langs))
    names = np.array([refs.of(x) for x in langs], dtype=object)
    for name in sorted(set(names[ok])):
        rows = np.flatnonzero(ok & (names == name))
        char_d[rows] = js_distance(chars[rows] / chars[rows].sum(1, keepdims=True), refs.chars[name])
        words = {w: i for i, w in enumerate(refs.words[name])}
        word_d[rows] = js_distance(_word_counts(t, words, rows) / t.lengths[rows][:, None], refs.shares[name])
    return chars.sum(1).astype(np.int64), t.lengths, char_d, word_d, ok


def judge(docs: DataFrame, refs: References | None = None, key: str = "doc_id", labels: DataFrame | None = None) -> DataFrame:
    """(key, chars, words, char_distance, word_distance, keep) for each row of `docs`."""
    held = docs.sparkSession.sparkContext.broadcast(refs or fit_good(docs, labels))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in arrow_batches(batches):
            chars, words, cd, wd, ok = distances(b.column(2), _langs(b.column(1)), held.value)
            keep = ~ok | ((cd <= CHAR_LIMIT) & (wd <= WORD_LIMIT))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chars), pa.array(words), pa.array(cd, mask=~ok), pa.array(wd, mask=~ok), pa.array(keep)], [key, "chars", "words", "char_distance", "word_distance", "keep"])

    return docs.select(F.col(key), F.col("lang").cast("string"), "text").mapInArrow(run, f"`{key}` {kind}, chars long, words long, char_distance double, word_distance double, keep boolean")


def kept_rows(text: pa.Array, lang: pa.Array, refs: References) -> np.ndarray:
    """Whether each row is kept, judged a few MB of text at a time, however long the batch."""
    out = [np.zeros(0, bool)]
    for b in arrow_batches([pa.RecordBatch.from_arrays([text, lang], ["text", "lang"])]):
        _, _, cd, wd, ok = distances(b.column(0), _langs(b.column(1)), refs)
        out.append(~ok | ((cd <= CHAR_LIMIT) & (wd <= WORD_LIMIT)))
    return np.concatenate(out)


def keep_column(docs: DataFrame, refs: References) -> Column:
    """Whether a row of `docs` is kept; the text goes to Python, the other columns don't."""
    held = docs.sparkSession.sparkContext.broadcast(refs)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array, lang: pa.Array) -> pa.Array:
        return pa.array(kept_rows(text, lang, held.value))

    return kept(docs["text"], docs["lang"].cast("string"))


def keep_typical(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` that the rules keep."""
    return docs.where(keep_column(docs, fit_good(docs, labels)))
