"""Claims: which chunks a request names, as semi-joins and equi-joins on shared terms and forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ident_norm, lex_terms, variants
from .structural import SUBSTRING_TERMS, specific, usable

GRAM = 4


def pinned(path: Column, explicit: list[str], strict: bool = False) -> Column:
    """Equal to, or ending in, an explicit path; ``strict`` asks for a directory boundary before it."""
    ends = lambda p: path.endswith("/" + p) if strict else path.endswith(p)
    return F.exists(F.array(*[F.lit(p) for p in explicit]), lambda p: path == p) | _any([ends(p) for p in explicit])


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def authority(path: Column, patterns: list[str]) -> Column:
    """Shell patterns on the path or its name, where * crosses directories; or equality, or a suffix at a boundary."""
    base = F.element_at(F.split(path, "/"), -1)
    tests = []
    for p in patterns:
        p = p.lstrip("./")
        shell = "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/- " else "\\" + c) for c in p) + "$"
        tests += [path.rlike(shell), base.rlike(shell), path.endswith("/" + p)]
    return _any(tests)


def matched(own: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """by..., key, score, terms, specific: usable terms that a chunk's names share with a request.

    ``own`` has key, path, name and term (all terms of a name), ``asked`` by... and term.  The score is the best name's share
    of usable shared terms in all its terms and the request's; specific says whether one of them is in few files.
    """
    n_task = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_task"))
    n_own = own.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n_own"))
    freq, total = file_frequency(own)
    fit = F.size(usable(F.array("term"))) == 1
    hit = own.join(asked, "term").join(freq, "term", "left").crossJoin(F.broadcast(total))  # total is one row
    rare = fit & specific(F.col("n_files"), F.col("n"))
    each = hit.groupBy(*by, "key", "name").agg(F.count(F.lit(1)).alias("shared"), F.collect_set(F.when(fit, F.col("term"))).alias("found"), F.max(rare).alias("rare")).where(F.size("found") > 0)  # a name's terms
    scored = each.join(n_own, ["key", "name"]).join(n_task, by).withColumn("s", F.size("found") / (F.col("n_own") + F.col("n_task") - F.col("shared")))
    return scored.groupBy(*by, "key").agg(F.max("s").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("terms"), F.max("rare").alias("specific"))


def file_frequency(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """term, n_files; and one row with n, the number of files."""
    freq = own.select("path", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_files"))
    return freq, own.agg(F.count_distinct("path").alias("n"))


def inside(own: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """by..., key of chunks with a name that contains a usable and specific term of a request of SUBSTRING_TERMS at most."""
    freq, total = file_frequency(own)
    few = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= SUBSTRING_TERMS).drop("m")
    terms = asked.join(few, by).where(F.size(usable(F.array("term"))) == 1).join(freq, "term", "left").crossJoin(F.broadcast(total))  # total is one row
    terms = terms.where(specific(F.col("n_files"), F.col("n"))).select(*by, "term")
    names = own.select("key", F.lower("name").alias("name")).distinct()
    found = contains_pairs(names.select(F.col("name").alias("path")).distinct(), terms.select(F.col("term").alias("name")).distinct())
    found = found.select(F.col("path").alias("held"), F.col("name").alias("term"))
    return terms.join(found, "term").join(names, F.col("held") == names["name"]).select(*by, "key").distinct()


def test_pairs(sources: DataFrame, tests: DataFrame, by: str) -> DataFrame:
    """by, key of the test chunks whose file name starts with test_ and whose path holds the base name of a claimed source.

    ``sources`` has by and path, ``tests`` key and path."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.py|\.tsx?|\.jsx?", "")
    peers = tests.where(F.element_at(F.split(F.lower("path"), "/"), -1).startswith("test_"))
    asked = sources.select(by, base.alias("name")).distinct()
    pairs = contains_pairs(peers.select("path").distinct(), asked.select("name").distinct())
    return asked.join(pairs, "name").join(peers, "path").select(by, "key").distinct()


test_pairs.__test__ = False


def contains_pairs(paths: DataFrame, names: DataFrame) -> DataFrame:
    """path, name of every path that contains a name: names meet paths by the rarest of their GRAM-character pieces, then are
    checked, so that a common piece pairs only names that have no rarer one."""
    low = F.lower("path")
    grams = paths.select("path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("path") - GRAM + 1)), lambda i: F.substring(low, i, F.lit(GRAM))))).alias("gram"))
    short = F.length("name") < GRAM
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = names.where(~short).select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - GRAM + 1), lambda i: F.substring("name", i, F.lit(GRAM))))).alias("gram"))
    rarest = own.join(often, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("name", F.col("g.gram").alias("gram"))
    long_pairs = grams.join(rarest, "gram").where(F.contains(F.lower("path"), F.col("name"))).select("path", "name")
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("path") - n + 1)), lambda i: F.substring(low, i, F.lit(n)))
    every = paths.select("path", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in range(1, GRAM)]))).alias("name"))
    return long_pairs.unionAll(every.join(names.where(short & (F.length("name") > 0)), "name").select("path", "name"))


def forms(name: Column) -> Column:
    """Every spelling under which a stated name may meet a symbol."""
    low = F.lower(name)
    base = F.concat(F.array(low, ident_norm(name)), variants(low))
    return F.array_distinct(F.concat(base, F.transform(base, ident_norm)))


def resolve(stated: DataFrame, symbols: DataFrame) -> DataFrame:
    """item, symbol: the first symbol in order that shares a form with the item; null if none does."""
    left = stated.select("item").distinct().select("item", F.explode(forms(F.col("item"))).alias("form"))
    right = symbols.select("symbol").distinct().select("symbol", F.explode(forms(F.col("symbol"))).alias("form"))
    found = left.join(right, "form").groupBy("item").agg(F.min("symbol").alias("symbol"))
    return stated.select("item").distinct().join(found, "item", "left")


def nearest(stated: DataFrame, symbols: DataFrame, parts, k: int = 3) -> DataFrame:  # noqa: ANN001
    """item, symbol, shared, rank: the k symbols that share most parts with the item, then by name."""
    left = stated.select("item").distinct().select("item", F.explode(F.array_distinct(parts(F.col("item")))).alias("part"))
    right = symbols.select("symbol").distinct().select("symbol", F.explode(F.array_distinct(parts(F.col("symbol")))).alias("part"))
    shared = left.join(right, "part").groupBy("item", "symbol").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy("item").orderBy(F.desc("shared"), F.asc("symbol"))
    return shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gate(needs: DataFrame, known: DataFrame) -> DataFrame:
    """item, term, kept: whether the corpus knows the term."""
    return needs.join(known.select("term", F.lit(True).alias("_k")).distinct(), "term", "left").select("item_id", "term", F.col("_k").isNotNull().alias("kept"))


def with_reasons(found: DataFrame, by: list[str]) -> DataFrame:
    """by..., reasons: the distinct reasons of each claim in order; ``found`` has by... and reason."""
    return found.groupBy(*by).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))  # a claim's reasons


def candidates(claimed: DataFrame, by: list[str]) -> DataFrame:
    """The claims with a reason that is more than a note of low specificity."""
    return claimed.where(F.exists("reasons", lambda r: ~r.endswith("_low_specificity"))).select(*by)


def stated_terms(kept: DataFrame, resolved: DataFrame) -> DataFrame:
    """term: need terms that the gate kept, and the terms of stated items that were resolved (item, symbol)."""
    items = resolved.where(F.col("symbol").isNotNull()).select(F.explode(usable(lex_terms(F.col("item")))).alias("term"))
    return kept.where("kept").select("term").unionByName(items).distinct()


def resolution(resolved: DataFrame) -> DataFrame:
    """One row: items, how many were resolved and how many not, and a note if any is left."""
    sums = resolved.agg(F.count(F.lit(1)).alias("total"), F.count("symbol").alias("resolved"))
    left = F.col("total") - F.col("resolved")
    return sums.select("total", "resolved", left.alias("unresolved"), F.when(left > 0, F.format_string("%d stated items are not in the index", left)).otherwise("").alias("note"))


def stated_summary(cited: DataFrame, stated: DataFrame, request: str, key: str) -> DataFrame:
    """request, origin, chunks: in how many packed claims a term of each origin is cited; one claim may count under several."""
    hit = cited.join(stated.select(request, "term", "origin"), [request, "term"]).select(request, "origin", key).distinct()
    return hit.groupBy(request, "origin").agg(F.count(F.lit(1)).alias("chunks"))
