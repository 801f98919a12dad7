"""Invariants and hand-worked values of the engine's operators."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import text as t
from sieveline.operators import chunking, claims, evaluate, index, lexical, packing, post, privacy, report, structural
from sieveline.sources import corpus
from sieveline.streaming import ledger


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_lex_terms(spark):
    got = one(spark, t.lex_terms(F.col("x")), x="retries parseHTTPServer stopped class_ bus é")
    assert got == ["retries", "retrie", "retry", "parsehttpserver", "parse", "http", "server", "stopped", "stopp", "stoppe", "stop", "class_", "bus"]
    assert one(spark, t.token_count(F.lit("  "))) == 1 and one(spark, t.token_count(F.lit(""))) == 0
    assert one(spark, t.lines(F.lit("a\r\nb\n\nc\n"))) == ["a", "b", "", "c"]
    assert one(spark, t.sentinels(F.lit("It is NOT a <> b, x >= 1 > 0"))) == ["<", ">", ">=", "is", "not"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \t.", max_size=30), max_size=30), st.integers(1, 20), st.integers(0, 10))
def test_windows_cover_and_advance(lines, target, overlap):
    lines = [x + "\n" for x in lines]
    got = list(chunking.windows(lines, target, overlap))
    assert set(range(len(lines))) == {i for s, e in got for i in range(s, e)}
    assert all(a[0] < b[0] <= a[1] for a, b in zip(got, got[1:], strict=False))
    assert all(e - s == 1 or sum(chunking.count(x) for x in lines[s:e]) <= target for s, e in got)


def test_symbols_and_symbol_chunks(spark):
    source = "import os\n\n@cache\ndef f():\n    return 1\n\nclass A:\n    def g(self):\n        pass\n"
    assert chunking.python_symbols(source) == [("f", 4, 5), ("A", 7, 9), ("g", 8, 9)]
    assert chunking.python_symbols("def (") == []
    script = "export function run(a) {\n  if (a) {\n  }\n}\nclass B {\n}\ntype T = string;\nconst k = 1\ninterface I {\n a: 1\n}\n"
    assert sorted(chunking.script_symbols(script)) == [("B", 5, 6), ("I", 9, 11), ("T", 7, 7), ("k", 8, 9), ("run", 1, 4)]
    files = spark.createDataFrame([("a.py", "python", source), ("b.txt", "unknown", "x\ny\n"), ("c.py", "python", None)], "path string, language string, content string")
    got = chunking.chunks(files, 12, 0, "symbol").where("path = 'a.py'").orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in got] == [(1, 5), (7, 9)]
    assert {r["name"] for r in chunking.symbols(files).collect()} == {"f", "A", "g"}
    with pytest.raises(ValueError):
        chunking.chunks(files, strategy="none")


def test_globs():
    import re

    hit = lambda g, p: bool(re.search(corpus.glob_regex(g), p))
    assert hit("**/.env", ".env") and hit("**/.env", "a/b/.env") and not hit("*.py", "a/b.py") and hit("src/**", "src/a/b") and hit("a?.c", "ab.c") and not hit("a.c", "abc")


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    files = {"src/a.py": b"x = 1\n", "src/b.bin": b"a\0b", "node_modules/c.js": b"1", "secret.env": b"k", "src/big.txt": b"y" * 200, "src/bad.txt": b"\xff\xfe"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["rel_path"]: (r["language"], r["reason"]) for r in corpus.scan(spark, str(tmp_path), ["**/*.env"], 100).collect()}
    assert got == {"src/a.py": ("python", None), "src/b.bin": ("unknown", "binary"), "node_modules/c.js": ("javascript", "ignored_dir"), "secret.env": ("unknown", "policy_deny"), "src/big.txt": ("text", "too_large"), "src/bad.txt": ("text", "not_utf8")}


def test_small_sources(spark, tmp_path):
    (tmp_path / "tasks").write_text('{"task": "fix it"}\nplain words\n\n{"task": broken\n')
    assert [r["task"] for r in corpus.task_lines(spark, str(tmp_path / "tasks")).collect()] == ["fix it", "plain words", '{"task": broken']
    rows = spark.createDataFrame([(1, "select", 1, 10, 5, 1.5)], corpus.LEDGER)
    corpus.append_ledger(rows, str(tmp_path / "ledger"))
    corpus.append_ledger(rows, str(tmp_path / "ledger"))
    (tmp_path / "ledger" / "part-x.json").write_text("{broken\n")
    assert corpus.ledger(spark, str(tmp_path / "ledger")).count() == 2


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, "")], "id long, text string")
    asked = lexical.query_terms(spark.createDataFrame([(9, "cat cat")], "q long, text string"), ["q"], "text")
    got = {r["id"]: r["score"] for r in lexical.bm25(docs, "id", "text", asked, ["q"]).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got == {1: pytest.approx(2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (4 / 3))))}
    with pytest.raises(ValueError):
        lexical.fuse(docs, ["id"], "id", "mean")


def test_structural_scores(spark):
    terms = F.array(F.lit("discount"), F.lit("rate"))
    explicit = F.array(F.lit("src/a.py"), F.lit("b.py"), F.lit("lib"))
    score = lambda p, e=explicit: one(spark, structural.path_score(F.lit(p), e, terms, F.lit(True)))
    assert (score("src/a.py"), score("x/b.py"), score("lib/z.py"), score("q/discount_x.py")) == (1.0, 0.8, 0.8, pytest.approx(1 / 3))
    rare = F.array(F.lit("rate"))
    assert one(spark, structural.symbol_score(F.lit("applyDiscount"), terms, rare)) == pytest.approx(1 / 4)
    assert one(spark, structural.symbol_score(F.lit("celebrate"), terms, rare)) == 0.6
    assert one(spark, structural.category(F.lit("tests/a.py"), F.lit(None).cast("string"), F.array().cast("array<string>"))) == "test"
    assert one(spark, structural.recency_score(F.lit(10))) == 0.5


def test_pins_and_authority(spark):
    assert one(spark, claims.pinned(F.lit("src/discount.py"), ["count.py"])) and not one(spark, claims.pinned(F.lit("src/discount.py"), ["count.py"], True))
    assert one(spark, claims.authority(F.lit("docs/a/rules.md"), ["docs/*.md"])) and one(spark, claims.authority(F.lit("x/env"), [".env"]))


def test_contains_pairs(spark):
    rng = random.Random(1)
    paths = ["".join(rng.choice("abc/_") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    names = sorted({"".join(rng.choice("abc_") for _ in range(rng.randint(1, 6))) for _ in range(30)})
    got = claims.contains_pairs(spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {tuple(r) for r in got.collect()} == {(p, n) for p in paths for n in names if n in p} and got.count() == got.distinct().count()


def test_folds_skip_what_does_not_fit(spark):
    items = [(1, 1, 50, "a"), (2, 2, 60, "a"), (3, 3, 40, "b"), (4, 4, 30, "b")]
    rows = spark.createDataFrame([(0, *i) for i in items], "q long, rank long, key long, tokens long, path string")
    got = packing.gather(rows, "q").select(packing.greedy(F.col("items"), 100).alias("g"), packing.breadth(F.col("items"), 100).alias("b"), packing.claims(F.col("items"), 100, 0.5).alias("c"), packing.tail(F.col("items"), F.array(F.lit("a")), F.lit(55), 100).alias("t")).first()
    assert [[x["key"] for x in got[k]] for k in "gbct"] == [[1, 3], [1, 3], [1], [3]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 4), st.booleans(), st.booleans(), st.sets(st.integers(0, 6))), max_size=15), st.integers(1, 150))
def test_pack_invariants(specs, budget):
    rows = [{"key": i, "tokens": n, "path": f"p{p}", "pinned": pin, "claim": claim, "score": 1 / (i + 1), "rank": i, "terms": [str(x) for x in terms]} for i, (n, p, pin, claim, terms) in enumerate(specs)]
    got = packing.pack_one(rows, budget)
    keys = [k for k, _ in got]
    size = {r["key"]: r["tokens"] for r in rows}
    assert len(keys) == len(set(keys)) and [p for _, p in got] == sorted((p for _, p in got), key=list(packing.passes()).index)
    pins = sum(size[k] for k, p in got if p == "pin")
    assert sum(size[k] for k in keys) <= max(budget, pins) and {r["key"] for r in rows if r["pinned"]} <= set(keys)
    seen = {r["path"] for r in rows if r["key"] in keys}
    assert all(r["path"] in seen or sum(size[k] for k in keys) + r["tokens"] > budget for r in rows)  # no path that fits is left out


def test_index_operations(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, content_hash string")
    assert {tuple(r) for r in index.incremental_diff(new, old).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "stale"), ("d", "new")}
    assert {tuple(r) for r in index.replace_paths(old, new).collect()} == {("a", "1"), ("b", "9"), ("c", "3"), ("d", "4")}


def test_logs(spark):
    roles = {"12 passed in 0.1s": "summary", "tests/a.py::t ... ok": "test_ok", "FAIL: x": "test_fail", "FATAL boom": "error", "WARNING: y": "warning", "Collecting z": "install", " 45%": "progress", '  File "a.py", line 3': "frame", " ": "blank", "words": "plain"}
    got = spark.createDataFrame([(k,) for k in roles], "line string").select("line", post.line_role(F.col("line")).alias("r")).collect()
    assert {r["line"]: r["r"] for r in got} == roles
    assert one(spark, post.clean_line(F.lit("\x1b[31mred\x1b[0m 10%\rdone  "))) == "done"


def test_redaction():
    text = "mail a@b.org and a@b.org, key AKIA" + "A" * 16 + ", db postgres://u:p@h:5432/d, c@d.org"
    got, kinds = privacy.redact_text(text)
    assert got == "mail <REDACTED_EMAIL_1> and <REDACTED_EMAIL_1>, key <REDACTED_API_KEY_1>, db <REDACTED_DATABASE_URL_1>, <REDACTED_EMAIL_2>"
    assert kinds == ["aws_access_key", "database_url", "email"] and privacy.redact_text(got)[1] == []


def test_rendering(spark):
    assert one(spark, post.compact_row(F.lit("a,b"), F.lit('q"x'), F.lit(None).cast("string"), F.lit(3))) == '"a,b","q""x",,3'
    assert one(spark, post.excluded_by(F.lit("src/a/b.py"), ["x", "src/a"])) == "src/a"
    assert '"cache_control":{"type":"ephemeral"}' in one(spark, post.messages_json(F.lit("s"), F.lit("t"), F.lit("m")))


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "q long, d long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 99)], "q long, d long")
    got = {r["q"]: r for r in evaluate.ranking(ranked, relevant, "q", "d").collect()}
    assert got[1]["recall"] == 0.5 and got[1]["mrr"] == 0.5 and got[1]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got[2]["recall"], got[2]["mrr"]) == (0.0, 0.0)
    for n in (1, 2, 5, 6):
        rows = spark.range(n).selectExpr("id", "0 AS g")
        assert report.at_rank(rows, "g", "id", {"m": report.upper_median_rank()}).first()["m"] == n // 2


def test_streaming_ledger(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = ledger.daily(ledger.read_events(spark, str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("days").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("days").agg(F.sum("runs")).first()[0] == events.count()
    seen = []
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a").write_text("x\ny\n")
    files = spark.readStream.schema("value string").text(str(tmp_path / "text"))
    ledger.refresh(files, lambda df, _: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [2]


def test_engine_end_to_end(spark):
    from sieveline.engine import Engine

    files = [("src/discount.py", "python", "def apply_discount(price):\n    return price * 0.9\n"), ("src/stock.py", "python", "def count_stock():\n    return 1\n"), ("tests/test_discount.py", "python", "def test_discount():\n    assert apply_discount(1)\n"), ("docs/mail.md", "markdown", "Write to a@b.org about discount prices.\n")]
    engine = Engine(spark)
    with pytest.raises(ValueError):
        engine.score(None)
    engine.index(spark.createDataFrame(files, "path string, language string, content string"))
    requests = spark.createDataFrame([(1, "How does apply_discount change the price"), (2, "count the stock")], "request_id long, task string")
    got = engine.select(requests, 60, explicit=["mail.md"], exclude=["src/stock.py"]).orderBy("request_id", "position").collect()
    first = [r for r in got if r["request_id"] == 1]
    pin = next(r for r in first if r["pass"] == "pin")
    assert (pin["path"], pin["strategy"], pin["category"]) == ("docs/mail.md", "verbatim", "supporting") and "<REDACTED_EMAIL_1>" in pin["content"] and "explicit_path" in pin["reasons"]
    kinds = [packing.CATEGORIES.index(r["category"]) for r in first]
    assert kinds == sorted(kinds)
    assert ("src/discount.py", "claim", "apply_discount") in {(r["path"], r["pass"], r["symbol"]) for r in first}
    assert "src/stock.py" not in {r["path"] for r in got} and sum(r["tokens"] for r in first) <= 60
    evidence = engine.select(requests, 60)
    assert engine.markdown(evidence).count() == 2
    assert {r["request_id"]: r["selected_tokens"] > 0 for r in engine.accounting(requests, evidence).collect()} == {1: True, 2: True}


def test_engine_claims(spark):
    """Pins need no shared term; paths, tests of claimed sources and authorities are claims with their reasons."""
    from sieveline.engine import Engine

    files = [("src/a.py", "python", "def price():\n    return 1\n"), ("src/util_price.py", "python", "x = 1\n"), ("tests/test_util_price.py", "python", "y = 2\n"), ("notes/zzz.md", "markdown", "nothing alike\n"), ("rules/main.md", "markdown", "law\n")]
    engine = Engine(spark)
    engine.index(spark.createDataFrame(files, "path string, language string, content string"))
    requests = spark.createDataFrame([(1, "change util_price"), (2, "run the regression of util_price"), (3, "see test_util_price")], "request_id long, task string")
    got = {(r["request_id"], r["key"].rpartition(":")[0]): r["reasons"] for r in engine.claims(requests, ["zzz.md"], ["rules/*"]).collect()}
    assert got[1, "src/util_price.py"] == ["named_path"] and got[1, "notes/zzz.md"] == ["explicit_path"] and got[1, "rules/main.md"] == ["authority"]
    assert "test_pair" in got[1, "tests/test_util_price.py"] and got[1, "src/a.py"] == ["named_symbol"]
    assert {r["request_id"]: r["wants_tests"] for r in engine.wants_tests(requests).collect()} == {1: False, 2: True, 3: True}
    packed = engine.select(requests, 100, explicit=["zzz.md"]).collect()
    for q in (1, 2, 3):
        own = {r["path"]: r for r in packed if r["request_id"] == q}
        assert own["notes/zzz.md"]["pass"] == "pin" and own["src/util_price.py"]["pass"] == "claim"
        assert (own["tests/test_util_price.py"]["pass"] == "claim") == (q != 1)
    rows = engine.candidates(requests, required=["src/a.py", "gone.py"])
    assert rows.where("required").count() == 3
    import json

    counts = {r["request_id"]: json.loads(r["diagnostics"]) for r in packing.diagnostics(rows, "request_id", 100).collect()}
    assert len(counts) == 3 and all(c["used_tokens"] <= 100 and c["budget_feasible"] and sum(c["per_file_tokens"].values()) == c["used_tokens"] for c in counts.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 6), st.booleans(), st.booleans()), min_size=1, max_size=60), st.integers(1, 150))
def test_shortlist_rules_keep_the_pack(specs, budget):
    """Packs of all rows and of those that ``shortlist`` keeps are the same, with limits small enough to bind."""
    rows = [{"key": i, "tokens": n, "path": f"p{p}", "pinned": pin and i % 7 == 0, "claim": claim and i % 5 == 0, "score": 1 / (i + 1), "rank": i + 1, "terms": [str(n % 5), str(p)]} for i, (n, p, pin, claim) in enumerate(specs)]
    held = packing.CLAIMS, packing.PATHS, packing.DEPTH
    packing.CLAIMS, packing.PATHS, packing.DEPTH = 2, 3, 4
    try:
        least: dict[str, int] = {}
        kept = []
        for r in rows:
            first = 4 + 2 + 3 + sum(x["pinned"] for x in rows)
            if r["pinned"] or r["claim"] or r["rank"] <= first or r["tokens"] < least.get(r["path"], 1 << 30):
                kept.append(r)
            least[r["path"]] = min(r["tokens"], least.get(r["path"], 1 << 30))
        assert packing.pack_one(rows, budget) == packing.pack_one(kept, budget)
    finally:
        packing.CLAIMS, packing.PATHS, packing.DEPTH = held


def test_labels_and_coverage(spark):
    chunks = spark.createDataFrame([("k1", "a", 1, 10, None), ("k2", "a", 11, 20, "f"), ("k3", "b", 1, 5, None)], "key string, path string, start_line int, end_line int, symbol string")
    labels = spark.createDataFrame([(1, "required", "a", None, [2, 9]), (1, "helpful", "a", "f", None), (1, "irrelevant", "b", None, None), (2, "required", "a", None, [5, 12]), (2, "required", "b", None, None), (2, "irrelevant", "b", None, [1, 5])], "q long, kind string, path string, symbol string, lines array<int>")
    got = {(r["q"], r["key"]): r["relevant"] for r in evaluate.relevance_labels(chunks, labels, "q").collect()}
    assert got == {(1, "k1"): 1, (1, "k2"): 1, (1, "k3"): 0, (2, "k3"): 0}  # lines 5 to 12 are inside no chunk
    required = spark.createDataFrame([(1, "a"), (1, "x"), (1, "b"), (2, "b")], "q long, path string")
    packed = spark.createDataFrame([(1, "a", 5), (2, "a", 9)], "q long, path string, tokens long")
    assert {tuple(r) for r in packing.coverage(required, chunks, packed, "q", 9).collect()} == {(1, "x", "not_indexed"), (1, "b", "dropped"), (2, "b", "budget")}
    runs = spark.createDataFrame([(100, 50), (100, 10), (0, 0), (200, 100)], "candidate_tokens long, selected_tokens long")
    assert tuple(evaluate.batch_totals(runs).first()) == (4, 400, 160, 50.0)


def test_compress(spark):
    from sieveline.operators import compress

    noise = "\n".join(f"Collecting pkg{i}" for i in range(30))
    body = f"{noise}\ntests/a.py::x ... ok\nb\nc\nd\nFAIL: boom\nWARNING: took 1 s\nWARNING: took 2 s\n"
    rows = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "a")], "id long, content string")
    got = {r["id"]: r for r in compress.compress(rows, "id", "content", "test", context=1).collect()}
    assert got[1]["compressed"] == "[30 install lines]\nb\nc\nd\nFAIL: boom\nWARNING: took 1 s" and got[1]["tokens_after"] < got[1]["tokens_before"]
    assert [got[i]["compressed"] for i in (2, 3, 4)] == ["", "", "a"]
    with pytest.raises(ValueError):
        compress.compress(rows, "id", "content", "other")


def test_token_classifier():
    import numpy as np

    from sieveline.operators import token_classifier as c

    w = c.train()
    fresh = [r for r in c.generated(7, 60) if len(r[0]) >= 12]
    p = c.softmax(np.array([[*c.features(t), 1.0] for t, _ in fresh]) @ w)
    sure = p.max(1) >= c.CONFIDENT
    right = p.argmax(1) == np.array([y for _, y in fresh])
    assert right[sure].mean() > 0.97 and sure.mean() > 0.5


def test_claim_list_and_order():
    base = {"claim": True, "pinned": False, "tokens": 1, "terms": [], "score": 1.0}
    rows = [base | {"key": i, "rank": i, **r} for i, r in enumerate([
        {"path": "a", "symbol_terms": ["x"]}, {"path": "a", "symbol_terms": ["x"]}, {"path": "a", "symbol_terms": ["y"]}, {"path": "a", "symbol_terms": ["x"], "named_path": True},
        {"path": "a", "strong": False}, {"path": "b", "strong": False}, {"path": "b", "strong": False}, {"path": "t", "is_test": True}, {"path": "c", "claim": False},
    ])]
    assert [r["key"] for r in packing.claim_list(rows, wants_tests=False)] == [0, 2, 3, 5]
    assert 7 in [r["key"] for r in packing.claim_list(rows)]
    some = [base | {"key": i, "rank": i, **r} for i, r in enumerate([{"path": "a", "symbol_terms": ["x"], "relevance": 9.0}, {"path": "b", "symbol_terms": ["x"], "on_path": True, "relevance": 1.0}, {"path": "c", "relevance": 2.0, "overlap": 0}, {"path": "d", "relevance": 2.0, "overlap": 1}])]
    assert [r["key"] for r in packing.claim_order(some)] == [2, 3, 1, 0]
    assert [r["key"] for r in packing.claim_order(some, {"d"})] == [3, 2, 1, 0]


def test_small_functions(spark):
    assert one(spark, t.ascii_words(F.lit("Él Niño_1, él"))) == ["el", "nino_1"]
    assert one(spark, t.path_norm(F.lit("a\\é"))) == "a/é"
    assert one(spark, t.budget_slices(F.lit("abcde"), 2)) == ["ab", "cd", "e"] and one(spark, t.budget_slices(F.lit(""), 2)) == []
    scored = spark.createDataFrame([(1, 1, None), (1, 2, 0.1), (1, 3, 0.9)], "q long, d long, score double")
    assert {(r["d"], r["rank"]) for r in evaluate.rerank(scored, "q", "d").collect()} == {(3, 1), (2, 2), (1, 3)}
    labels = spark.createDataFrame([(1, "a"), (1, "b")], "q long, path string")
    assert evaluate.label_rate(labels, labels.where("path = 'a'"), "q").first()["rate"] == 0.5
    assert evaluate.task_set_digest(labels, "path").first() == evaluate.task_set_digest(labels.orderBy(F.desc("path")), "path").first()
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    changed, gone = index.refresh_pinned(old, old.where("path = 'a'").withColumn("content_hash", F.lit("9")), F.col("path").isin("a", "b"))
    assert [r["path"] for r in changed.collect()] == ["a"] and [r["path"] for r in gone.collect()] == ["b"]
    assert index.forget(old, gone).count() == 2
    missed = spark.createDataFrame([(1, 2, "y", "budget"), (1, 1, "x", "capped")], "q long, place int, path string, reason string")
    assert "- x (capped)\n- y (budget)" in packing.recovery_prompt(missed, "q").first()["prompt"]


def test_words_fold_alike_in_batches_and_columns(spark):
    words = "cats class bus ties tied running ing ed red planned hoped FooBar HTTPServerError snake_case _x a1B2 X9 stopped_Adding iEs".split()
    words += [w + e for w in ("a", "ab", "abc", "abb", "Abba") for e in ("", "s", "es", "ies", "ied", "ing", "ed", "ss", "us")]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", t.word_terms(F.col("w")).alias("t")).collect()
    for r in rows:
        assert sorted(r["t"]) == sorted(t.fold_word(r["w"])), r["w"]


def test_bm25_is_the_same_by_joins(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * k) % 7} things" for k in range(i % 5))) for i in range(30)] + [(99, None)], "id long, text string")
    asked = lexical.query_terms(spark.createDataFrame([(1, "word1 word2 word2 thing"), (2, "nowhere"), (3, "word6")], "q long, text string"), ["q"], "text")
    fast = {(r["q"], r["id"]): r["score"] for r in lexical.bm25(docs, "id", "text", asked, ["q"]).collect()}
    best = [(r["q"], r["id"]) for r in lexical.bm25(docs, "id", "text", asked, ["q"], 3, 6).collect()]
    monkeypatch.setattr(lexical, "ASKED", 0)
    slow = {(r["q"], r["id"]): r["score"] for r in lexical.bm25(docs, "id", "text", asked, ["q"]).collect()}
    assert fast.keys() == slow.keys() and fast and all(abs(fast[k] - slow[k]) < 1e-9 for k in fast)
    want = [k for q in (1, 3) for k in sorted((k for k in fast if k[0] == q), key=lambda k: (-round(fast[k], 6), k))[:3]]
    assert sorted(best) == sorted(want) == sorted((r["q"], r["id"]) for r in lexical.bm25(docs, "id", "text", asked, ["q"], 3, 6).collect())
