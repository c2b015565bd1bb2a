"""Titles, first sentences and slugs of regions (T17 to T19), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

ATX = r"^#{1,6}\s+\S"
#: A line of one mark, three times or more.
ADORNMENT = "^(?:" + "|".join(f"{c}{{3,}}" for c in ["=", "-", "~", "`", ":", "#", '"', "'", r"\^", "_", r"\*", r"\+"]) + ")$"
MACHINE = r"^(?:```|\$ |> |\{\{#|\{\{%|<a |<span )"
LINK_ITEM = r"^[-*]\s+\[[^\]]+\]\(.+\)$"


def first_sentence(text: Column, least: int = 30, most: int = 180) -> Column:
    """Up to the first full stop, semicolon or colon (tried in that order) between `least` and `most` characters, else a cut with dots."""
    flat = T.squeeze(text)
    out = F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("..."))
    for mark in (": ", "; ", ". "):
        at = F.instr(flat, mark) - 1
        out = F.when((at >= least) & (at <= most), F.substring(flat, F.lit(1), at + 1)).otherwise(out)
    return F.when(F.length(flat) <= most, flat).otherwise(out)


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(line), "^#+", ""))


def region_title(text: Column, most: int = 180) -> Column:
    """An ATX heading of the first 20 lines, else a line with a line of marks under (or over) it, else the first line of prose of the first 8."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    atx = F.get(F.filter(F.slice(lines, 1, 20), lambda x: x.rlike(ATX)), F.lit(0))
    pairs = F.arrays_zip(F.slice(lines, F.lit(1), F.size(lines) - 1).alias("a"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("b"))
    under = F.transform(
        pairs,
        lambda p: F.when((_bare(p["0"]) != "") & p["1"].rlike(ADORNMENT), _bare(p["0"])).when(p["0"].rlike(ADORNMENT) & (p["1"] != "") & ~p["1"].rlike(ADORNMENT), _bare(p["1"])),
    )
    rst = F.get(F.array_compact(under), F.lit(0))
    prose = F.get(F.filter(F.transform(F.slice(lines, 1, 8), _bare), lambda x: (x != "") & ~x.rlike(ADORNMENT) & ~x.rlike(MACHINE) & ~x.rlike(LINK_ITEM)), F.lit(0))
    return F.substring(F.coalesce(_bare(atx), rst, prose, F.lit("")), 1, most)


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by hyphens, "misc" where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "misc").otherwise(s)


def phrases(tokens: Column, most: int = 3) -> Column:
    """All phrases of 1 to `most` neighbouring tokens."""
    parts = [tokens]
    for n in range(2, most + 1):
        parts.append(F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i, n=n: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def crc_buckets(tokens: Column, buckets: int = 512) -> Column:
    """CRC-32 buckets of token pairs and of the first and last four characters of tokens."""
    pairs = F.when(F.size(tokens) >= 2, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))
    ends = F.flatten(F.transform(F.filter(tokens, lambda t: F.length(t) > 4), lambda t: F.array(F.concat(F.lit("^"), F.substring(t, 1, 4)), F.concat(F.substring(t, -4, 4), F.lit("$")))))
    return F.transform(F.concat(pairs, ends), lambda x: F.crc32(x.cast("binary")) % buckets)
