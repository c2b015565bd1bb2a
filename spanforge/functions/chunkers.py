"""Row-wise chunkers (C1-C8) for texts whose segmentation needs state that column expressions can't hold.

Each chunker maps a text to (start_line, end_line, kind, text) rows; `chunk_documents` runs one over a DataFrame in Arrow batches.
Line chunks have a column-only version in operators.regions, which is the one to use at scale.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

PREFIX = {"import": "I", "function": "F", "class": "C", "method": "M", "module": "G", "paragraph": "P", "line": "P", "token": "P"}


def label(kind: str, number: int) -> str:
    """Kind prefix and a number of two digits or more."""
    return f"{PREFIX.get(kind, 'P')}{number:02d}"


def line_chunks(text: str, size: int = 10):
    lines = text.split("\n")
    return [(i + 1, min(i + size, len(lines)), "line", "\n".join(lines[i : i + size])) for i in range(0, len(lines), size) if "".join(lines[i : i + size]).strip()]


def paragraph_chunks(text: str):
    """Runs of non-blank lines; fenced code, quotes and comment lines belong to none and end one."""
    out, start, fenced = [], None, False
    lines = text.split("\n")
    for i, line in enumerate([*lines, ""]):
        bare = line.strip()
        fence = bare.startswith("```")
        stop = not bare or fence or fenced or bare.startswith(("> ", "<!--")) or i == len(lines)
        if stop and start is not None:
            out.append((start + 1, i, "paragraph", "\n".join(lines[start:i])))
            start = None
        elif not stop and start is None:
            start = i
        if fence:
            fenced = not fenced
    return out


def token_chunks(text: str, tokens: int = 200):
    """Whole lines packed greedily; a line costs int(1.3 words)."""
    out, held, cost, first = [], [], 0, 0
    for i, line in enumerate(text.split("\n")):
        c = int(len(line.split()) * 1.3)
        if held and cost + c > tokens:
            out.append((first + 1, i, "token", "\n".join(held)))
            held, cost = [], 0
        if not held:
            first = i
        held.append(line)
        cost += c
    if held and "".join(held).strip():
        out.append((first + 1, first + len(held), "token", "\n".join(held)))
    return out


def _kind(node: ast.stmt) -> str:
    if isinstance(node, ast.Import | ast.ImportFrom):
        return "import"
    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
        return "function"
    return "class" if isinstance(node, ast.ClassDef) else "module"


def _first_line(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def python_chunks(text: str, methods: bool = False):
    """Top-level statements of Python source, text between them included; classes by method if asked. Broken source goes by lines."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return line_chunks(text)
    lines = text.split("\n")
    spans: list[tuple[int, int, str]] = []
    for node in tree.body:
        inner = [n for n in getattr(node, "body", []) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)] if methods and isinstance(node, ast.ClassDef) else []
        if not inner:
            spans.append((_first_line(node), node.end_lineno, _kind(node)))
            continue
        if (head := _first_line(inner[0]) - 1) >= _first_line(node):
            spans.append((_first_line(node), head, "class"))
        for i, n in enumerate(inner):
            last = _first_line(inner[i + 1]) - 1 if i + 1 < len(inner) else node.end_lineno
            spans.append((_first_line(n), last, "method"))
    out, at = [], 1
    for first, last, kind in spans:
        if first > at and "".join(lines[at - 1 : first - 1]).strip():
            out.append((at, first - 1, "module", "\n".join(lines[at - 1 : first - 1])))
        out.append((first, last, kind, "\n".join(lines[first - 1 : last])))
        at = last + 1
    if at <= len(lines) and "".join(lines[at - 1 :]).strip():
        out.append((at, len(lines), "module", "\n".join(lines[at - 1 :])))
    return out


#: C7. TypeScript needs a parser that isn't installed, and falls back to lines as the broken-source rule does.
CHUNKERS = {
    "line": line_chunks,
    "paragraph": paragraph_chunks,
    "token": token_chunks,
    "ast": python_chunks,
    "hybrid": lambda text: python_chunks(text, methods=True),
    "ts_ast": line_chunks,
    "ts_hybrid": line_chunks,
}


#: Characters of documents that are chunked at once (a single longer document is chunked whole).
CHARACTERS = 2_000_000


def chunk_documents(docs: DataFrame, chunker: str = "paragraph") -> DataFrame:
    """(doc_id, region_id, ordinal, start_line, end_line, kind, text) of each chunk. Batches are cut by characters, so that a task holds few texts at a time."""
    split = CHUNKERS[chunker]
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *((n, pa.string() if n in ("region_id", "kind", "text") else pa.int64()) for n in ("region_id", "ordinal", "start_line", "end_line", "kind", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, held = [[] for _ in schema], 0
            for doc_id, text in zip(*(batch.column(i) for i in range(2)), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                for n, (first, last, what, body) in enumerate(split(text), 1):
                    for column, value in zip(columns, (doc_id, label(what, n), n, first, last, what, body), strict=True):
                        column.append(value)
                held += len(text)
                if held >= CHARACTERS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                    columns, held = [[] for _ in schema], 0
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, region_id string, ordinal long, start_line long, end_line long, kind string, text string")


def safe_windows(tokens: list[int], budget: int, overlap: int = 0) -> list[tuple[int, int]]:
    """[start, stop) windows of whole regions within a token budget, overlapping by regions."""
    out, start = [], 0
    while start < len(tokens):
        stop, used = start, 0
        while stop < len(tokens) and (stop == start or used + tokens[stop] <= budget):
            used += tokens[stop]
            stop += 1
        out.append((start, stop))
        if stop >= len(tokens):
            break
        start = max(start + 1, stop - overlap)
    return out
