"""Corpora as DataFrames of files, the policy that lets a file in, and the small line-based sources."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The language of an extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "m": "objective-c", "mm": "objective-cpp", "rs": "rust", "go": "go",
    "java": "java", "rb": "ruby", "sh": "bash", "md": "markdown", "txt": "text",
}
# Directories that are never entered, and files that are never read.
IGNORED_DIRS = [".git", "node_modules", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".cache", "dist", "build", ".eggs"]
IGNORED_FILES = [".ds_store", ".localized"]


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: ** crosses directories, * and ? stay within one; a leading **/ may be empty."""
    start = ""
    if pattern.startswith("**/"):
        start, pattern = "(?:.*/)?", pattern[3:]
    tokens = re.findall(r"\*\*(?:/|$)|\*|\?|[^*?]+", pattern)
    known = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + start + "".join(known.get(x) or re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", x) for x in tokens) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def in_ignored_dir(path: Column) -> Column:
    parents = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(parents, lambda p: p.isin(IGNORED_DIRS) | p.endswith(".egg-info") | (p == "egg-info"))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(known, ext), F.lit("unknown"))


def skip_reason(path: Column, size: Column, text: Column, never_read: list[str], max_bytes: int) -> Column:
    """The first check that a file fails, null if none; what needs the content comes last."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    unsafe = path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    return (
        F.when(unsafe, "unsafe_path").when(in_ignored_dir(path), "ignored_dir").when(matches_any(path, never_read), "policy_deny").when(name.isin(IGNORED_FILES), "hidden_system")
        .when(size > max_bytes, "too_large").when(text.isNull(), "read_failed").when(F.instr(F.substring(text, 1, 8192), "\0") > 0, "binary").when(~F.is_valid_utf8(text), "not_utf8")
    )


def scan(spark: SparkSession, root: str, never_read: list[str] | None = None, max_bytes: int = 1_000_000) -> DataFrame:
    """rel_path, language, size_bytes, content_hash, modified, content and reason of every file under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    text = F.col("content").cast("string")
    reason = skip_reason(rel, F.col("length"), text, never_read or [], max_bytes)
    out = files.select(rel.alias("rel_path"), language(rel).alias("language"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), reason.alias("reason"), text.alias("content"))
    return out.withColumn("content", F.when(F.col("reason").isNull(), F.col("content"))).withColumn("content_hash", F.sha2("content", 256))


def documents_as_files(docs: DataFrame) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), language(path).alias("language"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"))


def task_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a JSON-lines or plain file: malformed JSON is kept as it is, blank lines are dropped."""
    raw = spark.read.text(path)
    task = F.coalesce(F.when(F.expr("try_parse_json(value)").isNotNull(), F.get_json_object("value", "$.task")), F.col("value"))
    return raw.where(F.trim("value") != "").select(F.trim(task).alias("task"))


LEDGER = "ts long, kind string, tasks long, candidate_tokens long, selected_tokens long, latency_ms double"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def label_tasks(spark: SparkSession, path: str) -> DataFrame:
    label = "array<struct<path:string,symbol:string,lines:array<int>>>"
    schema = f"task_id string, task string, repository_id string, token_budget int, difficulty string, required_chunks {label}, helpful_chunks {label}, irrelevant_chunks {label}, distractor_chunks {label}"
    return spark.read.schema(schema).option("multiLine", True).json(path)


class PathPolicy:
    """Which paths may be read: never those that a denied glob matches, unless a glob of ``allow_read`` does."""

    def __init__(self, denied: list[str], allow_read: list[str] | None = None) -> None:
        self.denied, self.allow_read = denied, allow_read or []

    def allowed(self, path: Column) -> Column:
        return ~matches_any(path, self.denied) | matches_any(path, self.allow_read)


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` laid on it: nested mappings are merged, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def layered(defaults: dict, *layers: dict | str | None) -> dict:
    """Settings from defaults and layers in order; a string is a YAML (or else JSON) file, a missing one or None is empty."""
    out = merged(defaults, {})
    for layer in layers:
        if isinstance(layer, str):
            try:
                raw = Path(layer).read_text(encoding="utf-8")
            except FileNotFoundError:
                continue
            try:
                import yaml

                layer = yaml.safe_load(raw)
            except ImportError:
                layer = json.loads(raw)
        out = merged(out, layer or {})
    return out


def repository_id(path: str) -> str:
    """A slug of a folder's name."""
    return re.sub(r"[^a-z0-9]+", "-", path.rstrip("/").rpartition("/")[2].lower()).strip("-") or "corpus"


def write_report(rows: DataFrame, folder: str, title: str) -> None:
    """A batch's rows, one a request, as JSON lines, and the same as a Markdown table; both written by executors."""
    rows.write.mode("append").json(f"{folder}/report.json")
    cells = F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]), " | "), F.lit(" |"))
    head = "\n".join([f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)])
    spark = rows.sparkSession
    lines = spark.createDataFrame([(0, head)], "at int, value string").unionByName(rows.select(F.lit(1).alias("at"), cells.alias("value")))
    lines.coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(f"{folder}/report.md")


def split_tasks(tasks: DataFrame, split: dict, digest: str | None) -> dict[str, DataFrame]:
    """The tasks of each part of a frozen split; ValueError if the task set's digest or its members do not match."""
    if split.get("task_set_hash") is not None and split["task_set_hash"] != digest:
        raise ValueError("the task set is not the one that was split")
    spark, out = tasks.sparkSession, {}
    for part in ("dev", "eval"):
        ids = spark.createDataFrame([(x,) for x in split.get(part, [])], "task_id string")
        lost = ids.join(tasks.select("task_id"), "task_id", "left_anti").count()
        if lost:
            raise ValueError(f"{lost} tasks of {part} are missing")
        out[part] = tasks.join(ids, "task_id", "left_semi")
    return out
