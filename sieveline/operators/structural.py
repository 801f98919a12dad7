"""Structural signals: frequencies of symbol and path terms, path and symbol scores, weights, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename_terms, lex_terms, usable

WEIGHTS = {"lexical": 0.35, "symbol": 0.25, "path": 0.15, "dependency": 0.10, "test": 0.10, "recency": 0.05}
FREQ_ABS, FREQ_SHARE, SUBSTRING_TERMS = 3, 0.01, 96


def term_files(files: DataFrame, path: str, terms: Column) -> DataFrame:
    """term, n_files: in how many files a term occurs."""
    return files.select(path, F.explode(F.array_distinct(terms)).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_files"))


def symbol_terms(symbols: Column) -> Column:
    return usable(F.flatten(F.transform(symbols, lex_terms)))


def specific(freq: Column, n_files: Column) -> Column:
    return F.coalesce(freq, F.lit(0)) <= F.greatest(F.lit(float(FREQ_ABS)), FREQ_SHARE * n_files)


def path_score(path: Column, explicit: Column, task_terms: Column, any_specific: Column) -> Column:
    """1 for an explicit path, 0.8 for a suffix or a component of it, else the matched share of the basename's terms."""
    own = basename_terms(path)
    matched = usable(F.array_intersect(own, task_terms))
    near = F.exists(explicit, lambda p: path.endswith(p) | F.array_contains(F.split(path, "/"), p))
    return F.when(F.array_contains(explicit, path), 1.0).when(near, 0.8).when(any_specific & (F.size(matched) > 0), F.size(matched) / F.size(own)).otherwise(0.0)


def symbol_score(symbol: Column, task_terms: Column, specific_terms: Column) -> Column:
    """Usable shared terms over the union of terms; else 0.6 if a specific task term is inside the symbol."""
    own = F.array_distinct(lex_terms(symbol))
    matched = usable(F.array_intersect(own, task_terms))
    inside = F.exists(specific_terms, lambda t: F.contains(F.lower(symbol), t))
    return F.when(F.size(matched) > 0, F.size(matched) / F.size(F.array_union(own, task_terms))).when((F.size(task_terms) <= SUBSTRING_TERMS) & inside, 0.6).otherwise(0.0)


def is_test(path: Column) -> Column:
    """By the lower-cased path: a file named test_..., ....test.ts or ....spec.ts, or one under tests/ at the root."""
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    return base.startswith("test_") | base.endswith(".test.ts") | base.endswith(".spec.ts") | low.startswith("tests/")


def test_pair_score(path: Column, symbol: Column) -> Column:
    return F.when(~is_test(path), 0.0).when(F.coalesce(symbol, F.lit("")).startswith("test_"), 0.5).otherwise(0.2)


def dependency_score(imports: Column, task_terms: Column) -> Column:
    n = F.size(imports)
    return F.when(n > 0, F.size(F.array_intersect(imports, task_terms)) / n).otherwise(0.0)


def recency_score(days: Column) -> Column:
    return F.when(days.isNull(), 0.0).otherwise(F.least(F.lit(1.0), 1 / (1 + 0.1 * F.greatest(days, F.lit(0)))))


def weighted(**scores: Column) -> Column:
    return sum((WEIGHTS[k] * v for k, v in scores.items()), F.lit(0.0))


def final(initial: Column, ml: Column | None = None) -> Column:
    return initial if ml is None else 0.45 * initial + 0.55 * ml


def category(path: Column, symbol: Column, file_symbols: Column) -> Column:
    return F.when(is_test(path), "test").when(symbol.isNotNull() | (F.size(file_symbols) > 0), "implementation").otherwise("supporting")
