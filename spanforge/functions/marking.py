"""Marking and editing of addressable text (family M): row-wise text surgery, with Arrow UDF wrappers."""

from __future__ import annotations

import ast
import difflib
import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .chunkers import CHUNKERS, label

#: M3: marker templates and what strips them.
FORMATS = {
    "bracket": ("[@{id}]", r"^\[@[A-Z]\d{2,}\]\n?"),
    "html": ("<!-- @{id} -->", r"^<!-- @[A-Z]\d{2,} -->\n?"),
    "hash": ("# @{id}", r"^# @[A-Z]\d{2,}\n?"),
    "slash": ("// @{id}", r"^// @[A-Z]\d{2,}\n?"),
    "dash": ("-- @{id}", r"^-- @[A-Z]\d{2,}\n?"),
    "percent": ("%% @{id}", r"^%% @[A-Z]\d{2,}\n?"),
    "semicolon": (";; @{id}", r"^;; @[A-Z]\d{2,}\n?"),
    "block": ("/* @{id} */", r"^/\* @[A-Z]\d{2,} \*/\n?"),
}
BY_EXTENSION = {".py": "hash", ".ts": "slash", ".js": "slash", ".sql": "dash", ".css": "block", ".html": "html", ".md": "bracket"}


def inject(text: str, extension: str = ".md", chunker: str = "paragraph", fmt: str | None = None) -> str:
    """M1: put a marker line before each chunk."""
    template = FORMATS[fmt or BY_EXTENSION.get(extension, "bracket")][0]
    lines = text.split("\n")
    for n, (first, _, kind, _) in sorted(enumerate(CHUNKERS[chunker](text), 1), reverse=True):
        lines.insert(first - 1, template.format(id=label(kind, n)))
    return "\n".join(lines)


def strip(text: str, fmt: str | None = None) -> str:
    """M2: take out the markers of one format, or of all."""
    for name, (_, pattern) in FORMATS.items():
        if fmt in (None, name):
            text = re.sub(pattern, "", text, flags=re.M)
    return text


def is_marked(text: str) -> bool:
    """M4."""
    return any(re.search(p.rstrip("\\n?"), text, flags=re.M) for _, p in FORMATS.values())


def blocks(text: str) -> list[tuple[str, int, int, str]]:
    """(id, first line, last line, body) of marked text; a block runs to the next marker, text before the first is lost."""
    lines = text.split("\n")
    marks = []
    for i, line in enumerate(lines):
        for _, pattern in FORMATS.values():
            if re.match(pattern.removesuffix(r"\n?") + "$", line):
                marks.append((i, re.search(r"[A-Z]\d{2,}", line)[0]))
                break
    out = []
    for k, (i, ref) in enumerate(marks):
        stop = marks[k + 1][0] if k + 1 < len(marks) else len(lines)
        out.append((ref, i + 2, stop, "\n".join(lines[i + 1 : stop])))
    return out


class EditError(ValueError):
    """An edit that can't be applied as asked."""


def search_replace(body: str, search: str, replace: str) -> str:
    """M6: the searched text must occur exactly once."""
    if body.count(search) != 1:
        raise EditError(f"found {body.count(search)} times")
    return body.replace(search, replace)


def line_edits(body: str, edits: list[dict]) -> str:
    """M6: {start, end (exclusive), expected, text} edits on 1-based lines, checked and applied from the end."""
    lines = body.split("\n")
    for e in sorted(edits, key=lambda e: -e["start"]):
        old = "\n".join(lines[e["start"] - 1 : e["end"] - 1])
        if e.get("expected") is not None and old != e["expected"]:
            raise EditError("expected text differs")
        lines[e["start"] - 1 : e["end"] - 1] = e["text"].split("\n") if e["text"] else []
    return "\n".join(lines)


def unified_diff(body: str, patch: str) -> str:
    """M6: apply the hunks of a unified diff exactly."""
    lines, out, at = body.split("\n"), [], 0
    rows = patch.split("\n")
    i = 0
    while i < len(rows):
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", rows[i])
        i += 1
        if not m:
            continue
        start = int(m[1]) - 1
        out += lines[at:start]
        at = start
        while i < len(rows) and not rows[i].startswith("@@"):
            mark, rest = rows[i][:1], rows[i][1:]
            if mark in (" ", "-"):
                if at >= len(lines) or lines[at] != rest:
                    raise EditError("context differs")
                at += 1
            if mark in (" ", "+"):
                out.append(rest)
            i += 1
    return "\n".join(out + lines[at:])


def apply_edits(marked: str, edits: list[dict], extension: str = ".md", base_hash: str | None = None) -> str:
    """M5: replace, delete, insert_before or patch_within blocks of marked text; overlapping edits and broken Python are refused."""
    if base_hash and hashlib.sha256(marked.encode()).hexdigest()[:16] != base_hash:
        raise EditError("the text changed since it was read")
    found = {b[0]: b for b in blocks(marked)}
    if len({e["ref"] for e in edits if e["action"] != "insert_before"}) < sum(e["action"] != "insert_before" for e in edits):
        raise EditError("two edits of one region")
    lines = marked.split("\n")
    for e in sorted(edits, key=lambda e: -found[e["ref"]][1] if e["ref"] in found else 0):
        if e["ref"] not in found:
            raise EditError(f"no region {e['ref']}")
        _, first, last, body = found[e["ref"]]
        if e["action"] == "delete":
            lines[first - 2 : last] = []
        elif e["action"] == "insert_before":
            lines[first - 2 : first - 2] = e["text"].split("\n")
        elif e["action"] == "replace":
            lines[first - 1 : last] = e["text"].split("\n")
        elif e["action"] == "patch_within":
            patch = {"search_replace": lambda b: search_replace(b, e["search"], e["text"]), "line_edits": lambda b: line_edits(b, e["edits"]), "unified_diff": lambda b: unified_diff(b, e["patch"])}
            lines[first - 1 : last] = patch[e.get("format", "search_replace")](body).split("\n")
        else:
            raise EditError(f"unknown action {e['action']}")
    out = "\n".join(lines)
    if extension == ".py" and not is_valid_python(strip(out)):
        raise EditError("the result is no valid Python")
    return out


def is_valid_python(text: str) -> bool:
    """M13."""
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


def highlight(text: str, refs: list[str], context: int = 2) -> str:
    """M9: the lines of some regions with line numbers and lines around them."""
    lines, out = text.split("\n"), []
    for ref, first, last, _ in blocks(text):
        if ref in refs:
            lo, hi = max(1, first - context), min(len(lines), last + context)
            out.append(f"[{ref}]\n" + "\n".join(f"{'>' if first <= i <= last else ' '} {i:4d} {lines[i - 1]}" for i in range(lo, hi + 1)))
    return "\n".join(out)


def side_by_side(old: str, new: str) -> list[tuple[str, str, str]]:
    """(op, old line, new line) rows of an alignment."""
    a, b = old.split("\n"), new.split("\n")
    rows = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for k in range(max(i2 - i1, j2 - j1)):
            rows.append((op, a[i1 + k] if i1 + k < i2 else "", b[j1 + k] if j1 + k < j2 else ""))
    return rows


def enrich_prompt(task: str, marked: str) -> str:
    """A prompt that shows marked text and how to name its regions."""
    return f"{task}\n\nName regions by their markers, such as P01 or P01-P03.\n\n{marked}\n"


@F.pandas_udf(StringType())
def inject_udf(text: pd.Series) -> pd.Series:
    return text.fillna("").map(inject)


@F.pandas_udf(StringType())
def strip_udf(text: pd.Series) -> pd.Series:
    return text.fillna("").map(strip)
