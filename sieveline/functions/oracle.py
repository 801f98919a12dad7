"""The same text functions in DuckDB SQL, as text to build queries from."""

from __future__ import annotations

from .text import GENERIC_TERMS, SENTINELS, TERM_LENGTH

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]"


def tokens(text: str) -> str:
    return f"(CASE WHEN coalesce(length({text}), 0) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all({text}, '{TOKEN}'))) END)"


def lines(text: str) -> str:
    return f"(CASE WHEN coalesce({text}, '') = '' THEN [] WHEN {text} LIKE '%' || chr(10) THEN string_split({text}, chr(10))[:-2] ELSE string_split({text}, chr(10)) END)"


def parts(name: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace({name}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_'), lambda x: x <> '')"


def variants(t: str) -> str:
    n = f"length({t})"
    return f"""list_distinct(list_filter([
        CASE WHEN {n} >= 4 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' AND {t} NOT LIKE '%us' THEN left({t}, {n} - 1) END,
        CASE WHEN {n} >= 5 AND ({t} LIKE '%ies' OR {t} LIKE '%ied') THEN left({t}, {n} - 3) || 'y' END,
        CASE WHEN {n} >= 6 AND {t} LIKE '%ing' THEN left({t}, {n} - 3) END,
        CASE WHEN {n} >= 6 AND {t} LIKE '%ing' THEN left({t}, {n} - 3) || 'e' END,
        CASE WHEN {n} >= 5 AND {t} LIKE '%ed' THEN left({t}, {n} - 2) END,
        CASE WHEN {n} >= 5 AND {t} LIKE '%ed' THEN left({t}, {n} - 2) || 'e' END,
        CASE WHEN {n} >= 6 AND {t} LIKE '%ed' AND {t}[{n} - 2] = {t}[{n} - 3] THEN left({t}, {n} - 3) END], lambda v: v IS NOT NULL AND v <> {t}))"""


def bag(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in ``name``(key, term): the bag of lexical terms of each row of ``source``."""
    return f"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z0-9_]+')) AS w FROM {source}),
        {name}_p AS (SELECT {key}, w, {parts("w")} AS p FROM {name}_w),
        {name}_s AS (SELECT {key}, lower(w) AS term FROM {name}_p UNION ALL SELECT {key}, lower(unnest(p)) FROM {name}_p WHERE len(p) > 1),
        {name} AS (SELECT {key}, term FROM {name}_s UNION ALL SELECT {key}, unnest({variants("term")}) FROM {name}_s)"""


GENERIC = ", ".join(f"'{t}'" for t in GENERIC_TERMS)
USABLE = f"length(term) >= {TERM_LENGTH} AND term NOT IN ({GENERIC})"
WORDS = "|".join(SENTINELS)
BASENAME = "regexp_replace(string_split({0}, '/')[-1], '\\.[^.]*$', '')"
