"""Secrets and personal data: rules of our own design for the known kinds, and placeholders that keep equal values equal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EDGE

#: Kind and rule in RE2's dialect, whose words are ASCII.
RULES = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "database_url": r"[a-z][a-z0-9+]{2,12}://[^\s:/@]+:[^\s:/@]+@[^\s/:]+(?::[0-9]+)?/[A-Za-z0-9_]+",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "api_token": r"\b(?:ghp_|sk-)[A-Za-z0-9]{32,}",
    "bearer_token": r"\bBearer [A-Za-z0-9._~+/-]{12,}|\bya29\.[A-Za-z0-9_-]{12,}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "high_entropy_token": r"\b[0-9a-f]{40}\b",
}
# What a kind is called in a placeholder.
LABELS = {"aws_access_key": "API_KEY", "api_token": "API_KEY", "bearer_token": "TOKEN", "private_key": "PRIVATE_KEY", "database_url": "DATABASE_URL", "email": "EMAIL", "high_entropy_token": "SECRET"}


def jvm(rule: str) -> str:
    return rule.replace(r"\b", EDGE)


def kind_counts(text: Column) -> list[Column]:
    return [F.size(F.regexp_extract_all(text, F.lit(jvm(rule)), F.lit(0))).cast("long").alias(kind) for kind, rule in RULES.items()]


def leaks(text: Column) -> Column:
    out = F.lit(False)
    for rule in RULES.values():
        out = out | text.rlike(jvm(rule))
    return out


def fail_closed(text: Column) -> Column:
    """The text, or nothing if a secret is left in it."""
    return F.when(leaks(text), F.lit("")).otherwise(text)


def redact_text(text: str, names: dict[str, str] | None = None, counts: dict[str, int] | None = None) -> tuple[str, list[str]]:
    """The text with placeholders, numbered by first appearance within a label, and the kinds found.

    ``names`` (of values) and ``counts`` (of labels) carry the numbering on from text to text."""
    names, counts = {} if names is None else names, {} if counts is None else counts
    found = sorted((m.start(), -m.end(), kind) for kind, rule in RULES.items() for m in re.finditer(rule, text, re.ASCII))
    out, last, kinds = [], 0, set()
    for start, end, kind in found:
        if start < last:
            continue
        label, value = LABELS[kind], text[start:-end]
        if value not in names:
            counts[label] = counts.get(label, 0) + 1
            names[value] = f"<REDACTED_{label}_{counts[label]}>"
        out += [text[last:start], names[value]]
        last = -end
        kinds.add(kind)
    return "".join([*out, text[last:]]), sorted(kinds)


def redact(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, redacted, kinds of every row, each numbered by itself."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [redact_text(x or "") for x in b.column("text").to_pylist()]
            yield pa.record_batch([b.column(key), pa.array([x for x, _ in both], pa.string()), pa.array([k for _, k in both], pa.list_(pa.string()))], names=[key, "redacted", "kinds"])

    return rows.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, redacted string, kinds array<string>")


def redact_requests(evidence: DataFrame, request: str, key: str, position: str, text: str) -> DataFrame:
    """request, key, redacted of the evidence of every request (a budget's worth of tokens), numbered through it in order."""
    kept = evidence.select(request, key, F.col(position).alias("_at"), F.col(text).alias("_text"))
    types = {c: kept.schema[c].dataType.simpleString() for c in (request, key)}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        names: dict[str, str] = {}
        counts: dict[str, int] = {}
        out = [redact_text(x or "", names, counts)[0] for x in t.column("_text").to_pylist()]
        return pa.table({request: t.column(request), key: t.column(key), "redacted": pa.array(out, pa.string())})

    return kept.groupBy(request).applyInArrow(run, f"`{request}` {types[request]}, `{key}` {types[key]}, redacted string")


def cleared(evidence: DataFrame, request: str, text: str) -> DataFrame:
    """The evidence of requests without a leak in any of it; nothing of the others."""
    bad = evidence.where(leaks(F.col(text))).select(request).distinct()
    return evidence.join(bad, request, "left_anti")
