"""After selection: exclusion, routing, log compaction, integrity, and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from pyspark.sql.window import Window

# What an extension says of a file's content, and what marks a log.
CODE = ["py", "ts", "tsx", "js", "jsx", "mts", "cts", "java", "go", "rs", "rb", "php", "c", "h", "cpp", "hpp", "cs", "swift", "kt", "scala", "sh", "sql"]
CONFIG = ["json", "yaml", "yml", "toml", "ini", "cfg", "env"]
DIFF = ["diff", "patch"]
PROSE = ["md", "rst", "txt"]
LOG_MARKS = ["traceback (most recent call last)", "test session starts", "passed, ", "failed, ", "error:"]


def excluded_by(path: Column, patterns: list[str]) -> Column:
    """The first pattern that excludes a path: equal, a raw suffix, or a directory above it; null if none."""
    tests = [F.when((path == p) | path.endswith(p) | path.startswith(p.rstrip("/") + "/"), F.lit(p)) for p in patterns]
    return F.coalesce(*tests, F.lit(None).cast("string"))


def content_type(path: Column, content: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    low = F.lower(content)
    log = F.lit(False)
    for m in LOG_MARKS:
        log = log | F.contains(low, F.lit(m))
    return F.when(ext.isin(DIFF), "diff").when(ext.isin(CONFIG) | name.startswith(".env"), "config").when(ext.isin(CODE), "code").when(ext.isin(PROSE), "prose").when(log, "log").otherwise("unknown")


def strategy(kind: Column, protected: Column) -> Column:
    return F.when(protected, "verbatim").when(kind.isin("code", "config", "diff"), "structural").when(kind == "log", "compact").otherwise("extractive")


# The patterns of a log line's role, in the order in which they are tried.
ROLES = {
    "summary": r"(?i)^[=\-\s#]*\d+\s+(passed|failed|error|errors|warning|warnings|skipped|collected)\b|^\s*Tests?:\s*\d+\s+(passed|failed|errors?)\b|^\s*\d+\s+.*\bin\s+\d+(?:\.\d+)?s\s*$|^\s*OK\s*$|^BUILD SUCCESSFUL|^Build succeeded|^Finished .* in \d|^Tests passed:",
    "test_fail": r"^(?:FAILED|ERROR)\s+\S+::|\.\.\.\s*(?:FAIL|ERROR)\b|^(?:FAIL|ERROR):\s+\S+|(?:^|\s)FAIL:\s+\S+",
    "test_ok": r"(?i)\.\.\.\s*ok\s*$|\bPASSED\b",
    "progress": r"^[\s.]*[.FEsx]{4,}\s*$|\d{1,3}%\s*[|\[#>]|\d{1,3}%\s*$|\d+(?:\.\d+)?(?:it|s|examples?)/s\]|^\s*[\[\(].*[|/#].*\]\s*$",
    "install": r"(?i)Requirement already satisfied|Downloading \S+-\d|Using cached |Installing collected packages|Successfully installed|Uninstalling |Attempting uninstall|Running setup\.py|Building wheel for|Installing backend|^\s*Collecting \S+|^\s*Installing collected|added \d+ packages|audited \d+ packages|^\s*(?:Compiling|Downloaded|Downloading)\s+\S+\s+v?\d|Downloaded crates|Updating crates|Locking \d+ packages|^\s*(?:Compiling|Fresh)\s",
    "frame": r'^\s*File "[^"]+", line \d+|^\s*at [\w.$<>~]+ \(.*:\d+:\d+\)|^\s*at [\w.$<>~]+ \(.*:\d+\)|^\s*-->\s+\S+:\d+:\d+|^\s*at\s+\S+:\d+:\d+',
    "error": r"^\s*(?:ERROR|FATAL|CRITICAL|error|Error)(?:\[[^\]]*\])?:|^\s*E\s+\S|^\s*Traceback \(most recent call last\):|^\s*(?:\w+\.)?\w*(?:Error|Exception|Failure):|:\s*(?:\w+\.)?\w*(?:Error|Exception)\s*$|Exception in thread|\bERROR\b|\bFATAL\b",
    "warning": r"^\s*(?:npm\s+)?(?:WARNING|WARN|Warning|warning)\b[:\s]|\bWARN(?:ING)?\b",
}
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)"


def clean_line(line: Column) -> Column:
    """Without terminal codes, what carriage returns overwrote, and white space at the end."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(line, ANSI, ""), "\r"), -1), r"\s+$", "")


def line_role(line: Column) -> Column:
    out = F.when(F.trim(line) == "", "blank")
    for role, pattern in ROLES.items():
        out = out.when(line.rlike(pattern), role)
    return out.otherwise("plain")


def _w(doc: str, line: str) -> Window:
    return Window.partitionBy(doc).orderBy(line)


def collapse_runs(rows: DataFrame, doc: str, line: str, roles: tuple[str, ...] = ("install", "progress")) -> DataFrame:
    """Each maximal run of one noisy role becomes its first line with a count; other lines stay, with count 1."""
    noisy = F.col("role").isin(*roles)
    new = ~noisy | (F.coalesce(F.lag("role").over(_w(doc, line)), F.lit("")) != F.col("role"))
    runs = rows.withColumn("_run", F.sum(new.cast("long")).over(_w(doc, line)))
    return runs.groupBy(doc, "_run").agg(F.min(line).alias(line), F.min_by("role", line).alias("role"), F.count(F.lit(1)).alias("n")).drop("_run")


def first_of_key(rows: DataFrame, doc: str, line: str, text: str) -> DataFrame:
    """Warnings and frames once a document each: by white space, and for warnings with digits masked."""
    key = F.trim(F.regexp_replace(text, r"\s+", " "))
    key = F.when(F.col("role") == "warning", F.regexp_replace(key, "[0-9]+", "#")).otherwise(key)
    once = F.col("role").isin("warning", "frame")
    firsts = rows.where(once).withColumn("_key", key).groupBy(doc, "role", "_key").agg(F.min(line).alias(line)).select(doc, line)
    return rows.where(~once).unionByName(rows.join(firsts, [doc, line], "left_semi"))


def failure_windows(rows: DataFrame, doc: str, line: str, context: int = 3) -> DataFrame:
    """Lines within ``context`` of an error or a failed test."""
    bad = F.col("role").isin("error", "test_fail").cast("int")
    return rows.withColumn("near", F.max(bad).over(_w(doc, line).rowsBetween(-context, context)) == 1)


def blank_runs(rows: DataFrame, doc: str, line: str) -> DataFrame:
    before = F.coalesce(F.lag("role").over(_w(doc, line)), F.lit(""))
    return rows.withColumn("_drop", (F.col("role") == "blank") & (before == "blank")).where(~F.col("_drop")).drop("_drop")


def trim_to_budget(rows: DataFrame, doc: str, line: str, budget: int) -> DataFrame:
    """Drops lines from the end, plain ones first, then frames and warnings, then the rest, until the tokens fit."""
    tier = F.when(F.col("role").isin("plain", "blank", "marker", "install", "progress"), 2).when(F.col("role").isin("frame", "warning"), 1).otherwise(0)
    order = Window.partitionBy(doc).orderBy(F.asc("_tier"), F.asc(line))
    return rows.withColumn("_tier", tier).withColumn("_upto", F.sum("tokens").over(order)).where(F.col("_upto") <= budget).drop("_tier", "_upto")


def intact(content: Column, body: Column) -> Column:
    own = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.when(own == "", "altered").when(F.contains(body, own), "intact").otherwise("altered")


# The order of sections.
SECTIONS = ["explicit", "interface", "implementation", "test", "supporting"]


def section_rank(section: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), section)


def markdown(rows: DataFrame, request: str) -> DataFrame:
    """request, markdown: a request's packed evidence in section order; packs are bounded by their budget."""
    piece = F.concat(F.lit("### "), F.col("path"), F.lit("\n"), F.col("content"), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct(section_rank(F.col("section")).alias("s"), F.col("position"), piece.alias("piece"))))
    return rows.groupBy(request).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n").alias("markdown"))


def messages_json(system: Column, task: Column, markdown_text: Column) -> Column:
    """A messages request: evidence with a cache breakpoint, then the task."""
    cached = F.struct(F.lit("text").alias("type"), markdown_text.alias("text"), F.struct(F.lit("ephemeral").alias("type")).alias("cache_control"))
    return F.to_json(F.struct(system.alias("system"), F.array(F.struct(F.lit("user").alias("role"), F.array(cached).alias("content")), F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), task.alias("text"), F.lit(None).cast("struct<type:string>").alias("cache_control"))).alias("content"))).alias("messages")))


def chat_json(system: Column, task: Column, markdown_text: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.array(turn("system", system), turn("user", F.concat(markdown_text, F.lit("\n"), task))).alias("messages")))


def compact_row(*columns: Column) -> Column:
    """Comma-separated values, quoted where they hold a comma, a quote or a line break."""

    def cell(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(",", *[cell(c) for c in columns])


def fingerprint(rows: DataFrame, request: str, columns: list[str]) -> DataFrame:
    """request, fingerprint of its rows in position order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", *columns)))
    return rows.groupBy(request).agg(F.sha2(F.to_json(ordered), 256).alias("fingerprint"))


def compact_evidence(content: Column, compacted: Column) -> dict[str, Column]:
    """The compacted form where it is strictly smaller in tokens, else the content as it is."""
    before, after = token_count(content), token_count(compacted)
    smaller = after < before
    return {"content": F.when(smaller, compacted).otherwise(content), "compacted": smaller, "tokens": F.when(smaller, after).otherwise(before)}
