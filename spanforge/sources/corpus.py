"""Corpus readers and record sinks (family S)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ["docx", "html", "md", "pdf", "rst", "txt"]
REGION = "doc_id string, region_id string, text string, start_line long, end_line long, ordinal long, hash string, source_path string, prev_region_id string, next_region_id string, parent_region_id string"
EXAMPLE = "query string, gold_refs array<string>, source_hashes map<string,string>, metadata map<string,string>"
EVENT = "query string, top_refs array<string>, shown_refs array<string>, clicked_ref string, click_ref string, selected_ref string, manual_ref string, useful boolean, feedback string, no_answer boolean, metadata map<string,string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """paragraphs' text runs; empty paragraphs are dropped, the others joined by a blank line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ["".join(t.text or "" for t in p.iter(_W + "t")) for p in root.iter(_W + "p")]
    return "\n\n".join(p for p in paragraphs if p.strip())


def pdf_text(content: bytes) -> str:
    """Each non-blank line is a paragraph. Needs the optional pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf, which isn't installed") from e
    lines = [line.strip() for page in PdfReader(io.BytesIO(content)).pages for line in (page.extract_text() or "").split("\n")]
    return "\n\n".join(line for line in lines if line)


def mapped_extension(path: str) -> str:
    """What a document is handled as once read."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return ".txt" if suffix in ("", "docx", "pdf") else "." + suffix


def glob_regex(pattern: str) -> str:
    return "^" + re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*", ".*").replace(r"\?", ".") + "$"


def slug(path):
    """Document ids: the path without extension, other characters than letters and digits as one underscore, lower case."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def read_corpus(spark: SparkSession, root: str, extensions: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, doc_id, extension, text, warning) of every file below `root`; HTML stays raw.

    Colliding ids get _2, _3 and so on in path order; `exclude` globs match the whole path or the file name.
    """
    from pyspark.sql.window import Window as W

    globs = "*.{" + ",".join(extensions or EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(root)
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    for pattern in exclude or []:
        rx = glob_regex(pattern)
        files = files.where(~F.col("path").rlike(rx) & ~F.element_at(F.split("path", "/"), -1).rlike(rx))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f.path, f.content, strict=True):
                kind, warning = path.rsplit(".", 1)[-1].lower(), None
                text = docx_text(content) if kind == "docx" else pdf_text(content) if kind == "pdf" else content.decode("utf-8-sig", "replace")
                if kind == "pdf" and len(text.split()) < 20:
                    warning = "little text in PDF"
                elif kind == "docx" and not text.strip():
                    warning = "empty DOCX"
                out.append((path, mapped_extension(path), text, warning))
            yield pd.DataFrame(out, columns=["path", "extension", "text", "warning"])

    rows = files.mapInPandas(read, "path string, extension string, text string, warning string")
    rows = rows.withColumn("s", slug(F.regexp_replace("path", "^" + re.escape(base), "")))
    n = F.row_number().over(W.partitionBy("s").orderBy("path"))
    return rows.withColumn("doc_id", F.when(n == 1, F.col("s")).otherwise(F.concat("s", F.lit("_"), n))).drop("s")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region rows from JSON lines; blank lines don't count."""
    return spark.read.schema(REGION).json(path).where("doc_id is not null")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """S13."""
    return spark.read.schema(EXAMPLE).json(path).where("query is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Feedback events with their alternative names folded and text feedback as yes, no or unknown."""
    e = spark.read.schema(EVENT).json(path).where("query is not null")
    low = F.lower("feedback")
    useful = F.coalesce("useful", F.when(low.isin("good", "helpful", "up", "useful", "yes"), True).when(low.isin("bad", "down", "no", "not_useful", "unhelpful"), False))
    return e.select("query", F.coalesce("top_refs", "shown_refs", F.array().cast("array<string>")).alias("top_refs"), F.coalesce("clicked_ref", "click_ref").alias("clicked_ref"), F.coalesce("selected_ref", "manual_ref").alias("selected_ref"), useful.alias("useful"), F.coalesce("no_answer", F.lit(False)).alias("no_answer"), "metadata")


def write_jsonl(df: DataFrame, path: str) -> None:
    """S8, S13, P8."""
    df.write.mode("overwrite").json(path)


def cached_views(regions: DataFrame, cache: DataFrame, provider) -> DataFrame:
    """Views from a cache keyed by (ref, hash); misses go through `provider` (DataFrame -> DataFrame of ref, hash, view)."""
    hit = regions.join(cache, ["ref", "hash"]).select("ref", "hash", "view")
    return hit.unionByName(provider(regions.join(cache, ["ref", "hash"], "left_anti")).select("ref", "hash", "view"))
