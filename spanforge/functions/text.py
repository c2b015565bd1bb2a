"""Text features as built-in column expressions (family T): tokenizers, normalisers, cues, numbers, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

ALIGN_STOP = sorted("and are at for from include including into least must provide require requires shall supplier tender that the this vendor was with".split())
ALIGN_ALIAS = dict(
    pair.split("=")
    for pair in sorted(
        "accounts=account completed=complete credits=credit cryptography=encryption customers=customer encrypt=encryption encrypted=encryption "
        "eu=europe european=europe expedited=expedited exports=export fees=fee including=include invoices=invoice outages=outage refunds=refund "
        "regions=region residency=residence resident=residence shipping=shipping totals=total".split()
    )
)
KEYWORD_STOP = sorted(
    "about all and any are but can document for from has have into its may not our section than that the their then there this use used using was were what when where which will with you your".split()
)
SMELL_STOP = sorted("about after also because before default documentation fastapi from have into more other that their there these this using when where which with".split())
#: cue -> substrings that set it; callers may pass another lexicon for corpora of invented words.
CUES = {
    "deprecated": ["legacy", "no longer", "removed", "deprecated"],
    "may": ["allowed", "can ", "optional", "permitted", "may"],
    "must": ["mandatory", "required", "shall", "must"],
    "must_not": ["cannot", "forbidden", "must not", "not allowed", "prohibited", "shall not"],
    "recommended": ["best practice", "preferred", "recommended"],
}
OPPOSED = [(["must"], ["may"]), (["may", "must", "recommended"], ["deprecated", "must_not"])]
LEDGER_MARKS = ["change log", "changelog", "changes.md", "news.md", "release notes", "release-notes", "release_notes"]
LEDGER_TERMS = ["contributors", "pr #", "pull request", "released", "translation", "version"]
UNITS = {"%": "percent", "days": "day", "hours": "hour", "kwh": "kwh", "years": "year"}


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def digest16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def region_hash(text: Column) -> Column:
    return digest16(squeeze(text))


def ascii_words(text: Column) -> Column:
    """Lifecycle tokens: lower-cased ASCII alphanumeric runs, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def fingerprint(text: Column) -> Column:
    return digest16(F.array_join(ascii_words(text), " "))


def quote(text: Column, tokens: int = 20) -> Column:
    """The first tokens of a text; empty if it has none."""
    return F.array_join(F.slice(ascii_words(text), 1, tokens), " ")


def _stem(x: Column) -> Column:
    n = F.length(x)
    alias = F.create_map(*[F.lit(v) for kv in ALIGN_ALIAS.items() for v in kv])
    return F.coalesce(
        F.element_at(alias, x),
        F.when(x.endswith("ies") & (n > 4), F.concat(x.substr(F.lit(1), n - 3), F.lit("y")))
        .when(x.endswith("ing") & (n > 5), x.substr(F.lit(1), n - 3))
        .when(x.endswith("ed") & (n > 4), x.substr(F.lit(1), n - 2))
        .when(x.endswith("s") & (n > 4), x.substr(F.lit(1), n - 1))
        .otherwise(x),
    )


def align_terms(text: Column) -> Column:
    """The set of stemmed ASCII words of two characters or more, without stopwords."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9_]{2,}"), F.lit(0)), _stem)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, ALIGN_STOP)))


def content_terms(text: Column) -> Column:
    return F.filter(align_terms(text), lambda t: ~t.rlike("^[0-9]+$"))


def smell_terms(text: Column) -> Column:
    """Distinct index tokens of four characters or more, without a short stop list."""
    kept = F.filter(index_tokens(text), lambda t: F.length(t) >= 4)
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, SMELL_STOP)))


def first_words(text: Column, n: int = 42) -> Column:
    """T4: the first n white-space words, blanks collapsed."""
    return F.array_join(F.slice(F.split(squeeze(text), " "), 1, n), " ")


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Jaccard of two arrays of distinct items; `empty` where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(empty)).otherwise(shared / union)


def bigrams(tokens: Column) -> Column:
    """Distinct adjacent token pairs, joined by a blank."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n, F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))
    return F.array_distinct(F.when(n >= 2, F.filter(pairs, lambda p: p.contains(" "))).otherwise(F.array().cast("array<string>")))


def cues(text: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Cues whose substrings occur, in name order. Plain substrings: "must" fires inside "mustard" too."""
    low = F.lower(text)
    found = []
    for name, words in sorted((lexicon or CUES).items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def opposed(a: Column, b: Column, pairs=None) -> Column:
    out = F.lit(False)
    for x, y in pairs or OPPOSED:
        left, right = F.array(*map(F.lit, x)), F.array(*map(F.lit, y))
        out = out | (F.arrays_overlap(a, left) & F.arrays_overlap(b, right)) | (F.arrays_overlap(a, right) & F.arrays_overlap(b, left))
    return out


def is_magnet(haystack: Column) -> Column:
    """Changelog-like text: a marker, or three ledger terms."""
    low = F.lower(haystack)
    mark = F.lit(False)
    for m in LEDGER_MARKS:
        mark = mark | low.contains(m)
    return mark | (sum((low.contains(t).cast("int") for t in LEDGER_TERMS), F.lit(0)) >= 3)


def number_units(text: Column) -> Column:
    """struct(number, unit) for each number, with the word after it."""
    low = F.lower(text)
    pattern = r"\b(\d+(?:\.\d+)?)\b(?:\s+([A-Za-z%]+))?"
    numbers = F.regexp_extract_all(low, F.lit(pattern), F.lit(1))
    units = F.regexp_extract_all(low, F.lit(pattern), F.lit(2))
    names = F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv])
    unit = lambda u: F.when(u == "", F.lit(None).cast("string")).otherwise(F.coalesce(F.element_at(names, u), F.regexp_replace(u, "s+$", "")))
    return F.zip_with(numbers, units, lambda n, u: F.struct(n.cast("double").alias("number"), unit(u).alias("unit")))


def numeric_conflict(source: Column, target: Column) -> Column:
    """A number of the source that no comparable number of the target satisfies."""
    s, t, low = number_units(source), number_units(target), F.lower(source)
    least = low.contains("at least") | low.contains("minimum")
    most = low.contains("within") | low.contains("no more than") | low.contains("maximum")

    def unmet(x: Column) -> Column:
        same = F.filter(t, lambda y: x["unit"].isNull() | y["unit"].isNull() | (x["unit"] == y["unit"]))
        pool = F.when(F.size(same) > 0, same).otherwise(t)
        ok = F.exists(pool, lambda y: F.when(least, y["number"] >= x["number"]).when(most, y["number"] <= x["number"]).otherwise(y["number"] == x["number"]))
        return ~ok

    return F.when((F.size(s) == 0) | (F.size(t) == 0), F.lit(False)).otherwise(F.exists(s, unmet))


def heading_level(text: Column) -> Column:
    """Number of leading # of the first line, 0 if it is no ATX heading."""
    return F.length(F.regexp_extract(text, r"^(#{1,6})\s+\S", 1))


def query_key(text: Column) -> Column:
    """Lower case, blanks collapsed."""
    return F.lower(squeeze(text))


def hashed_features(texts, key: str, buckets: int = 64):
    """Signed hashed bag (key, bucket, weight): weight 1 + ln(tf), bucket and sign from the token's digest."""
    t = texts.select(key, F.explode(index_tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    h = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.shiftright(h, 20) % 2 == 0, 1.0).otherwise(-1.0)
    return t.select(key, (h % buckets).alias("bucket"), (sign * (1 + F.log("tf"))).alias("w")).groupBy(key, "bucket").agg(F.sum("w").alias("weight"))
