"""Chunks and symbols of files: a fold over lines whose state has no SQL form runs over Arrow batches, a file a row."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
PIECES = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("tokens", pa.int32()), ("content", pa.string())]))
SPANS = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
MOST_LINES = 400


def count(text: str) -> int:
    return max(1, sum(1 for _ in TOKEN.finditer(text))) if text else 0


def windows(lines: list[str], target: int, overlap: int, most: int = MOST_LINES) -> Iterator[tuple[int, int]]:
    """Half-open ranges of whole lines of about ``target`` tokens, each starting a few lines before the last one's end."""
    cost, target = [count(x) for x in lines], max(1, target)
    head = lines[:5]
    back = max(1, int(overlap * len(head) / (count("".join(head)) or 1))) if overlap > 0 and head else 0
    at = 0
    while at < len(lines):
        stop, spent = at, 0
        while stop < len(lines) and stop - at < most and (stop == at or spent + cost[stop] <= target):
            spent += cost[stop]
            stop += 1
        yield at, stop
        if stop >= len(lines):
            return
        at = max(at + 1, stop - back)


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    kept: list[tuple[int, int]] = []
    for s, e in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if not kept or e > max(k[1] for k in kept):
            kept.append((s, e))
    return kept


def symbol_windows(lines: list[str], spans: list[tuple[int, int]], target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges that follow the outermost symbols and the gaps between them; a segment over target is cut by lines."""
    edges, at = [], 0
    for s, e in outermost(spans):
        s = max(at, s - 1)
        while s > at and lines[s - 1].lstrip().startswith("@"):
            s -= 1
        edges += [(at, s), (s, min(e, len(lines)))]
        at = max(at, e)
    edges.append((at, len(lines)))
    segments = [(s, e) for s, e in edges if e > s and "".join(lines[s:e]).strip()]
    held: tuple[int, int] | None = None
    for s, e in segments:
        if held and count("".join(lines[held[0] : e])) <= target:
            held = (held[0], e)
            continue
        if held:
            yield held
        if count("".join(lines[s:e])) > target:
            yield from ((s + a, s + b) for a, b in windows(lines[s:e], target, overlap))
            held = None
        else:
            held = (s, e)
    if held:
        yield held


def python_symbols(source: str) -> list[tuple[str, int, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [(n.name, n.lineno, n.end_lineno or n.lineno) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]


NAME = r"([A-Za-z_$][\w$]*)"
#: Kind of declaration, its pattern, and how many lines it may span.
DECLARED = [("block", re.compile(rf"\bfunction(?:\s+\*)?\s+{NAME}\s*\("), 200), ("block", re.compile(rf"\bclass\s+{NAME}"), 200), ("type", re.compile(rf"\b(?:interface|type|enum)\s+{NAME}\b"), 100), ("var", re.compile(rf"\b(?:const|let|var)\s+{NAME}\s*="), 1)]


def script_symbols(source: str) -> list[tuple[str, int, int]]:
    lines, found = source.splitlines(), {}
    for kind, pattern, most in DECLARED:
        for m in pattern.finditer(source):
            first = source.count("\n", 0, m.start())
            found.setdefault((m[1], first + 1), first + 2 if kind == "var" else _block_end(lines, first, most, kind == "type"))
    return [(name, start, end) for (name, start), end in found.items()]


def _block_end(lines: list[str], first: int, most: int, ends_at_semicolon: bool) -> int:
    depth, opened = 0, False
    for i, line in enumerate(lines[first : first + most], first + 1):
        depth += line.count("{") - line.count("}")
        opened = opened or "{" in line
        if opened and depth <= 0 or ends_at_semicolon and not opened and ";" in line:
            return i
    return first + 1 if ends_at_semicolon else min(first + 60, len(lines))


def symbols_of(language: str, source: str) -> list[tuple[str, int, int]]:
    if language == "python":
        return python_symbols(source)
    return script_symbols(source) if language in ("javascript", "jsx", "typescript", "tsx") else []


def chunks(files: DataFrame, target: int = 400, overlap: int = 40, strategy: str = "window") -> DataFrame:
    """path, start_line, end_line, tokens, content; ``strategy`` is window or symbol."""
    if strategy not in ("window", "symbol"):
        raise ValueError(f"strategy is window or symbol, not {strategy!r}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for language, text in zip(b.column("language").to_pylist(), b.column("content").to_pylist(), strict=True):
                lines = (text or "").splitlines(keepends=True)
                spans = [(s, e) for _, s, e in symbols_of(language, text or "")] if strategy == "symbol" else []
                ranges = symbol_windows(lines, spans, target, overlap) if spans else windows(lines, target, overlap)
                out.append([{"start_line": s + 1, "end_line": e, "tokens": count(own := "".join(lines[s:e])), "content": own} for s, e in ranges])
            yield pa.record_batch([b.column("path"), pa.array(out, PIECES)], names=["path", "pieces"])

    packed = files.select("path", F.col("language"), "content").mapInArrow(cut, "path string, pieces array<struct<start_line:int,end_line:int,tokens:int,content:string>>")
    return packed.select("path", F.explode("pieces").alias("p")).select("path", "p.*")


def symbols(files: DataFrame) -> DataFrame:
    """path, name, start, end, ord of every symbol."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"name": n, "start": s, "end": e} for n, s, e in symbols_of(lang, text or "")] for lang, text in zip(b.column("language").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("path"), pa.array(found, SPANS)], names=["path", "spans"])

    packed = files.select("path", "language", "content").mapInArrow(find, "path string, spans array<struct<name:string,start:int,end:int>>")
    return packed.select("path", F.posexplode("spans").alias("ord", "s")).select("path", "s.*", "ord")
