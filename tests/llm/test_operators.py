"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import json
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import chat_format, common, decontam, exact_dedup, html_extract, langid, line_dedup, mixing, quality, simhash, suffix_dedup
from sieveline.llm.common import join_heavy, table

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk int, bucket int, payload string, fp long, size long, rank long, key string, digest string, run int"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 1, "x", 1, 1, 1, "k", "d", 0) for i, t, s in rows], DOCS).repartition(3)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "délta", "eps", "z", "eta.", "Theta,", "iota"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(30) for _ in range(3)]
    rows = []
    for i in range(n):
        t = text(rng.randint(0, 40))
        if rng.random() < 0.5:
            t = t[: len(t) // 2] + rng.choice(shared) + t[len(t) // 2 :]
        if rng.random() < 0.2 and rows:
            t = rows[rng.randrange(len(rows))][1] or ""
            t = t.replace(" ", rng.choice([" ", "  ", "\n", "\t"]))
        rows.append((i * 7 - 30, t, rng.choice(["a", "b", "é", None])))
    return rows + [(1000, None, "a"), (1001, "", None), (1002, " \n\t", "b"), (1003, "ab" * 4000, "b"), (999, "ab" * 300, "b"), (998, "x" * 49, "a"), (997, "x" * 50, "a"), (996, "x" * 130, "a")]


@pytest.mark.parametrize("rows", [corpus(1), corpus(2), [], [(1, None, None)]])
def test_exact_dedup(spark, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {(i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}
    assert {tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()} == want


def test_exact_dedup_merges_runs_of_any_fan(spark):
    docs = docs_of(spark, corpus(3)).union(docs_of(spark, corpus(3))).repartition(70)
    got = exact_dedup.exact_dedup(docs, ranges=3).collect()
    assert len(got) == 2 * len(corpus(3)) and all(r["group_size"] % 2 == 0 for r in got)


def removed_bytes(rows, span=50):
    starts = {}
    for i, t, _ in rows:
        b, key = (t or "").encode(), float("inf") if i is None else i
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            starts[w] = min(starts.get(w, key), key)
    out = []
    for i, t, _ in rows:
        b, key = (t or "").encode(), float("inf") if i is None else i
        gone = [False] * len(b)
        for p in range(len(b) - span + 1):
            if starts[b[p : p + span]] < key:
                gone[p : p + span] = [True] * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [6000, 2])
@pytest.mark.parametrize("rows", [corpus(4), corpus(5, 100), corpus(6) + [(None, "ab" * 60, None), (-30, "ab" * 90, None)], [], [(1, None, None)]])
def test_suffix_dedup(spark, rows, hot):
    got = suffix_dedup.suffix_dedup(docs_of(spark, rows), hot).withColumn("kept", F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == removed_bytes(rows)


def test_suffix_pieces_agree(spark, monkeypatch):
    rows = corpus(7, 120)
    for name, value in (("PIECE", 97), ("SORTED", 200)):
        monkeypatch.setattr(suffix_dedup, name, value)
    got = suffix_dedup.suffix_dedup(docs_of(spark, rows)).withColumn("kept", F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == removed_bytes(rows)


def test_suffix_classes_are_in_suffix_order():
    import numpy as np

    text = bytes(random.Random(1).choice(b"ab") for _ in range(400))
    rank = suffix_dedup.classes(np.frombuffer(text, np.uint8))
    cut = [text[i : i + 50].ljust(50, b"\0") for i in range(len(text) - 49)]
    want = {w: i for i, w in enumerate(sorted(set(cut)))}
    order = {r: i for i, r in enumerate(sorted(set(rank[: len(cut)].tolist())))}
    assert [order[r] for r in rank[: len(cut)].tolist()] == [want[w] for w in cut]


def test_longest_previous_factors():
    """Against the definition: the longest prefix shared with a suffix of smaller value, capped at SPAN."""
    rng, span = random.Random(3), suffix_dedup.SPAN
    for letters, n in ((b"a", 300), (b"ab", 300), (b"abcdefgh", 200), (b"a", 1)):
        piece = bytes(rng.choice(letters) for _ in range(90))
        text = b"".join(piece[rng.randrange(20) :] if rng.random() < 0.6 else bytes([rng.choice(letters)]) for _ in range(n))[: n + 200].ljust(n + span, b"a")
        win = np.array(sorted(rng.sample(range(len(text) - span + 1), n)))
        value = np.array([rng.randrange(6) for _ in win])
        order = np.argsort(suffix_dedup.classes(np.frombuffer(text, np.uint8))[win], kind="stable")
        shared = suffix_dedup.common_prefixes(suffix_dedup.loads(np.frombuffer(text, np.uint8)), win[order])
        cut = [text[i : i + span] for i in win[order]]
        assert cut == sorted(cut)
        prefix = lambda a, b: next((i for i in range(span) if a[i] != b[i]), span)
        assert shared.tolist() == [0, *(prefix(cut[i - 1], cut[i]) for i in range(1, n))]
        got = suffix_dedup.longest_previous(value[order], shared)
        want = [max((prefix(cut[i], cut[j]) for j in range(n) if value[order][j] < value[order][i]), default=0) for i in range(n)]
        assert (got >= span).tolist() == [x >= span for x in want] and any(x >= span for x in want) == (n > 1)


def test_suffix_buckets_use_all_bits():
    h = np.random.default_rng(1).integers(0, 2**64, 4000, dtype=np.uint64)
    for n in (1, 48, 3 << 20, 1 << 30):
        b = suffix_dedup.bucket_of(h, n)
        assert b.min() >= 0 and b.max() < n and len(set(b.tolist())) > min(n - 1, 3900)
    low = np.random.default_rng(2).integers(0, 2**64, (4000, 31), dtype=np.uint64).min(1)  # minimisers are small hashes
    assert np.bincount(suffix_dedup.bucket_of(low, 48), minlength=48).max() < 150


@pytest.mark.parametrize("rows", [corpus(8), [(5, "One two three four five six. One two three four five six.", None), (3, "x\nOne  TWO three four five six.", None)], []])
def test_line_dedup(spark, rows):
    seen, want = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0], (r[1] or "").encode())):
        raw, gone, last, kept = (t or "").encode(), [], 0, b""
        for s, e, g in line_dedup.units(raw, 6):
            if g is not None and g in seen:
                gone.append((s, e))
                kept, last = kept + raw[last:s], e
            elif g is not None:
                seen.add(g)
        want[i] = (gone, (kept + raw[last:]).decode())
    got = line_dedup.line_dedup(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: ([tuple(x) for x in r["removed"]], r["kept_text"]) for r in got} == want


def test_line_dedup_of_short_lines(spark):
    """Short lines and lines without spaces go in later copies; a short sentence goes only with its longer neighbour."""
    poem = "".join(f"five short words line {i}\n" for i in range(20))
    chinese = "这是一个没有空格的段落" * 20 + "。\n"
    lone = "So be it. This long sentence number {} has more words. Quite so.\n"
    rows = [(1, "own one\n" + poem + chinese + lone.format(1), None), (2, "own two\n" + poem + chinese + lone.format(2), None), (3, lone.format(1) + "own three", None)]
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "own two\n" + lone.format(2)
    assert got[3].split() == ["own", "three"]


def test_units_tile_the_text():
    for t in ("", "a", "a.b c. d!\n\ne... f?g\n", "...", "3.5 kg.", "\n\n", "é. à"):
        raw, at = t.encode(), 0
        for s, e, _ in line_dedup.units(raw, 1):
            assert s == at
            at = e
        assert at == len(raw)


def bench_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(10, len(w))
        for g in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for s in range(len(words) - n + 1):
                if tuple(words[s : s + n]) == g:
                    hit.update(range(s, s + n))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found - {None}))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_decontaminate(spark, block_words):
    rng = random.Random(3)
    word = lambda: rng.choice(["Aa", "b1", "cé", "d", "É", "ff"])
    rows = [(i, rng.choice([" ", ", ", "-"]).join(word() for _ in range(rng.randint(0, 40))), None) for i in range(60)] + [(100, None, None), (101, "", None), (102, "aa", None)]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 6, 9, 10, 11, 14])))) for i in range(14)] + [(50, None), (51, "!?"), (2, "d d")]
    items += [(None, "aa b1 d"), (None, " ".join(rows[8][1].split()[:12]))]
    items += [(60, " ".join((rows[5][1] + rows[6][1]).split()[:15])), (61, rows[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs_of(spark, rows), bench, block_words).collect()
    assert {tuple(r)[:6] for r in got} == {(i, *bench_hits(t, items)) for i, t, _ in rows}


def test_filters_keep_whole_rows(spark):
    """The narrow filters decide as the scoring operators do, row by row, whatever other columns there are."""
    docs = spark.sql("SELECT id AS doc_id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 2 = 0 THEN 'a good text of words' ELSE 'bad bad bad zz' END AS text, 'x' AS raw, id AS row, named_struct('text', 1) AS score, 1.5D AS `a.b` FROM range(40)")
    docs = docs.union(docs.where("doc_id < 5"))
    labels = docs.selectExpr("doc_id", "CAST(text LIKE 'a%' AS int) AS quality").distinct()
    bench = spark.createDataFrame([(1, "good text of")], "item_id long, text string")
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    ids = {r["doc_id"] for r in quality.quality(docs, labels).where("predicted = 1").collect()}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] in ids) and 0 < len(ids) < 40
    free = decontam.clean(docs, bench)
    assert free.schema == docs.schema
    assert sorted(map(str, free.collect())) == sorted(str(r) for r in docs.collect() if "good" not in (r["text"] or ""))
    none = docs.where(F.lit(False))
    assert quality.good(none, labels).count() == decontam.clean(none, bench).count() == 0


def test_heavy_join(spark):
    left = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS v")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_heavy(left, right, ["k"], "n", 5000)
    assert sorted(map(tuple, got.select("v", "k", "n").collect())) == sorted(map(tuple, left.join(right, "k").select("v", "k", "n").collect()))


def test_decontaminate_without_benchmark(spark):
    got = decontam.decontaminate(docs_of(spark, corpus(9)), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(corpus(9)) and not any(r["contaminated"] for r in got)
    assert decontam.decontaminate(docs_of(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def brute_targets(size, total, ratio=1.5, weights=(3, 1, 2), repeat=2):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, goal = set(names), ratio * total, {}
    while free:
        share = {s: left * weigh[s] / sum(weigh[x] for x in free) for s in free}
        over = {s for s in free if share[s] > repeat * size[s]}
        goal |= {s: float(repeat * size[s]) for s in over} if over else share
        left -= sum(repeat * size[s] for s in over)
        free = free - over if over else set()
    return goal


def test_targets_share_the_excess(spark):
    rng = random.Random(3)
    for size in ({"a": 10, "b": 1000, "c": 1000, None: 500}, {f"é{i}": rng.choice([0, 1, 5, 90, 4000]) for i in range(23)}, {}):
        own = spark.createDataFrame([(s, n, 1) for s, n in size.items()], "source string, size long, n long")
        got = {r["source"]: r["target"] for r in mixing.targets(own, 1.5, (3, 1, 2), 2, sum(size.values())).collect()}
        assert got == pytest.approx(brute_targets(size, sum(size.values())))


def test_route_is_cheapest():
    """Against every possible flow of small networks: most words first, then least cost."""
    assert mixing.route([10, 10], [[0], [0, 1]], [15, 5], 2) == [[10], [5, 5]]
    assert sum(map(sum, mixing.route([10, 10], [[0], [0, 1]], [100, 100], 2))) == 40
    rng = random.Random(1)
    for _ in range(150):
        s = rng.randint(1, 3)
        member = [sorted(rng.sample(range(s), rng.randint(1, s))) for _ in range(rng.randint(1, 3))]
        supply, demand = [rng.randint(0, 2) for _ in member], [rng.randint(0, 5) for _ in range(s)]
        flow = mixing.route(supply, member, demand, 2)
        into = [sum(x for own, f in zip(member, flow, strict=True) for j2, x in zip(own, f, strict=True) if j2 == j) for j in range(s)]
        assert all(x <= d for x, d in zip(into, demand, strict=True)) and all(sum(f) <= 2 * n and min(f) >= 0 for f, n in zip(flow, supply, strict=True))
        price = lambda totals: (-sum(totals), sum(min(t, n) + 3 * max(0, t - n) for t, n in zip(totals, supply, strict=True)))
        best = []

        def each(i, left, totals, member=member, supply=supply, best=best, price=price):
            if i == len(member):
                best.append(price(totals))
                return
            for split in itertools.product(*(range(min(2 * supply[i], left[j]) + 1) for j in member[i])):
                if sum(split) <= 2 * supply[i]:
                    rest = list(left)
                    for j, x in zip(member[i], split, strict=True):
                        rest[j] -= x
                    each(i + 1, rest, [*totals, sum(split)])

        each(0, demand, [])
        assert price([sum(f) for f in flow]) == min(best)


def mixed_of(spark, rows):
    out, sources = mixing.mix(docs_of(spark, rows), F.array("source"))
    return out.collect(), {r["source"]: (r["source_size"], r["target"]) for r in sources.collect()}


@pytest.mark.parametrize("few", [20_000, 0])
@pytest.mark.parametrize("n", [0, 1, 130])
def test_mix(spark, monkeypatch, n, few):
    monkeypatch.setattr(common, "FEW", few)
    rows = corpus(11, n) if n > 1 else [(1, "a b c", None)][:n]
    got, sources = mixed_of(spark, rows)
    got = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    own, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        size = len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
        assert got[i]["size"] == size and got[i]["taken"] in (0, size, 2 * size)
        own[s] += size
        taken[s] += got[i]["taken"]
    goal = brute_targets(own, sum(own.values()))
    assert {s: x[0] for s, x in sources.items()} == own and {s: x[1] for s, x in sources.items()} == pytest.approx(goal)
    for s in own:
        assert abs(taken[s] - goal[s]) <= max(3, 0.02 * own[s]) and taken[s] <= goal[s] + 0.5
    again = {r["doc_id"]: r["taken"] for r in mixed_of(spark, rows[::-1])[0]}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_mix_of_repeated_rows(spark):
    """Rows that repeat a doc_id are mixed one by one, equal ones together; the words taken stay under the target."""
    rows = [(None, f"w{i} " * (i % 9), "a") for i in range(60)] + [(5, "x y z", "b")] * 40 + [(5, "x", "b"), (5, None, None)]
    got, sources = mixed_of(spark, rows)
    assert len(got) == len(rows)
    for s, (_, goal) in sources.items():
        taken = sum(r["taken"] for r in got if r["sources"] == [s])
        assert taken <= goal + 0.5 and (s != "a" or taken > goal - 9)
    docs = docs_of(spark, rows).withColumn("copies", F.lit("own")).withColumn("_taken", F.lit(1)).withColumn("number", F.lit(2))
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "mix_size", "mix_copies", "taken"]
    assert sorted(r["taken"] for r in out.collect()) == sorted(r["taken"] for r in got if r["copies"])


def test_mix_of_overlapping_sources(spark):
    """Two components of sources and one apart: words of each pattern as the cheapest flow has them."""
    tags = [["a", "b"], ["a"], ["b", None], ["c"], ["d", "e"], []]
    docs = spark.createDataFrame([(i, "w " * 10, tags[i % 6]) for i in range(360)], "doc_id long, text string, tags array<string>")
    out, sources = mixing.mix(docs, F.col("tags"), weights=(1, 2, 1))
    goal = {r["source"]: r["target"] for r in sources.collect()}
    own = {"a": 1200, "b": 1200, None: 600, "c": 600, "d": 600, "e": 600}
    assert {r["source"]: r["source_size"] for r in sources.collect()} == own and goal == pytest.approx(brute_targets(own, 3600, 1.5, (1, 2, 1)))
    taken = {json.dumps(r["sources"]): r["taken"] for r in out.groupBy("sources").agg(F.sum("taken").alias("taken")).collect()}
    assert out.where("taken > 2 * size").count() == 0 and taken["[]"] == 0
    order, names = [t for t in tags if t], ["a", "b", "c", "d", "e", None]
    flow = mixing.route([600] * 5, [[names.index(s) for s in t] for t in order], [round(goal[s]) for s in names], 2)
    for t, f in zip(order, flow, strict=True):
        assert sum(f) - 10 < taken[json.dumps(sorted(t, key=lambda s: (s is None, s or "")))] <= sum(f)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href=/x>X</a></ul></nav>
<div class="ad">Buy, buy, buy, now, it is cheap, and good, and near</div><!-- <p>gone</p> -->
<div id="content"><h2>Title &amp; more</h2><p>First   paragraph, with <b>bold<br>text</b>, and &eacute;t&#233;.<p>Second, unclosed
<ul><li>one, item<li>two</ul><pre>a
  b</pre>loose text, here</div><div class="comments"><p>I disagree, a lot, and at length, for ever, and ever</p></div>
<aside>Side</aside><form><p>Name <input></p></form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "Title & more\nFirst paragraph, with bold text, and été.\nSecond, unclosed\none, item\ntwo\na b\nloose text, here"
    assert html_extract.extract(PAGE) == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain text"), (5, "x", "<p>a<p>b &lt;i&gt;"), (6, "y", "<div"), (7, "z", "</p></div>x<br/>y"), (None, "q", "<nav>m</nav>"), (1, "u", PAGE)]
    got = html_extract.extract_pages(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted((str(i), t, len(t)) for i, t in [(1, want), (2, ""), (3, ""), (4, "plain text"), (5, "a\nb <i>"), (6, ""), (7, "x y"), (None, ""), (1, want)])


def test_html_names():
    page = '<body class="has-sidebar"><div class="content with-header" data-hidden="no" data-id="ad"><p>Kept, all of it</p></div><div class="post-comments"><p>gone</p></div><p hidden>gone</p><div role=alert><p>gone</div>'
    assert html_extract.extract(page) == "Kept, all of it"


def test_html_keeps_the_whole_article():
    many = "".join(f"<p>First {i}, " + "words, and words, " * 35 + "</p>" for i in range(12))
    page = f"<body><nav>no</nav><article><h1>Title</h1>bare intro<section>{many}</section><section><h2>More</h2><p>Second, short, and last of all</p></section><div><a href=x>Linked, elsewhere</a></div><aside>no</aside></article><footer>no</footer><div>Outside</div></body>"
    for own in (page, page.replace("<article>", '<div id="content">').replace("</article>", "</div>"), page.replace("<article>", "<main><div>").replace("</article>", "</div></main>")):
        got = html_extract.extract(own).split("\n")
        assert got[:2] == ["Title", "bare intro"] and got[-2:] == ["More", "Second, short, and last of all"] and len(got) == 16
    assert html_extract.extract(f"<body>Bare lead, of the page<div>{many}</div><div><a href=x>Links</a></div></body>").startswith("Bare lead, of the page\nFirst 0")


def test_html_deep_and_long():
    deep = "<div>" * 5000 + "<p>" + "word, " * 50_000 + "</p>" + "</div>" * 5000
    assert html_extract.extract(deep).count("word") == 50_000


def brute_chat(rows, part_chars):
    """conv, perspective, part -> messages, repeats, rendered text, masked pieces."""
    talks = defaultdict(lambda: defaultdict(int))
    for c, turn, role, text in rows:
        talks[c][turn is not None, turn or 0, "unknown" if role is None else role, text or ""] += 1
    out = {}
    for c, said in talks.items():
        for who in {k[2] for k in said} - {"system"}:
            before = 0
            for k in sorted(said):
                name, text = k[2], k[3]
                part = before // part_chars
                before += len("<|im_start|>") + len(name if name == "system" else "user name=" + name) + 1 + len(text) + len("<|im_end|>") + 1
                n, repeats, rendered, masks = out.get((c, who, part), (0, 0, "", ()))
                head = "<|im_start|>" + ("assistant" if name == who else name if name == "system" else "user name=" + name) + "\n"
                if name == who:
                    masks += ((len(rendered) + len(head), len(rendered) + len(head) + len(text) + 10),)
                out[c, who, part] = n + 1, repeats + said[k] - 1, rendered + head + text + "<|im_end|>\n", masks
    return out


def chat_of(spark, rows, part_chars=chat_format.PART):
    """Conversations with extra columns whose names the operator uses itself."""
    table_of = spark.createDataFrame([(*r, 0, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, part int, messages string, perspective string, own long")
    got = chat_format.rotate(table_of, part_chars).collect()
    assert len({tuple(r)[:3] for r in got}) == len(got)
    return {tuple(r)[:3]: (r["n_messages"], r["n_repeats"], r["rendered"], tuple((m["start"], m["end"]) for m in r["masks"])) for r in got}


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", "é\nx"), (1, 2, "bob", "é\nx"), (1, 40, "ann", None), (2, 0, "system", "only"), (None, None, None, "t"), (3, 0, "ann", "")]
    got = chat_of(spark, rows)
    assert got == brute_chat(rows, chat_format.PART) and {k[2] for k in got} == {0}
    assert got[1, "bob", 0][2] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\né\nx<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    assert chat_format.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("part_chars", [chat_format.PART, 700])
def test_chat_of_long_dialogues(spark, part_chars):
    """Many turns, many messages in one turn, null turns and a hot conversation; beyond the limit the parts join to the whole."""
    rng = random.Random(5)
    rows = [(c, rng.choice([None, 3, 200 - i, i]), rng.choice(["system", "ann", "bob", "çé", None]), "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 30)))) for c in (1, None) for i in range(150)]
    rows += [(4, i, "ann", "short") for i in range(3)] + [(5, 0, "zoe", "word " * 400)] + rows[:40]
    got = chat_of(spark, rows, part_chars)
    assert got == brute_chat(rows, part_chars)
    joined = defaultdict(str)
    for key in sorted(got, key=lambda k: (str(k[:2]), k[2])):
        joined[key[:2]] += got[key][2]
    assert joined == {k[:2]: v[2] for k, v in brute_chat(rows, chat_format.PART).items()}


def brute_simhash(text, k=3):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    ids = sorted(prints)
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("rows", [corpus(12), [], [(1, None, None)]])
def test_simhash(spark, rows):
    got = simhash.near_dedup(docs_of(spark, rows)).collect()
    prints = {i: brute_simhash(t) for i, t, _ in rows}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints, 3)


@pytest.mark.parametrize("tile", [4096, 7])
def test_links_and_components(spark, monkeypatch, tile):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):  # chains
        prints.append(rng.choice(prints) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 5))) & (2**64 - 1))
    prints = list(dict.fromkeys(prints))
    monkeypatch.setattr(simhash, "TILE", tile)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    nodes = spark.createDataFrame([(signed(p), i) for i, p in enumerate(prints)], "fp long, node long")
    for count in (100, 1 << 22, 1 << 30):
        keyed = nodes.select("fp", "node", F.explode(F.array(*simhash._block_keys(count, 3))).alias("key"))
        found = {r["node"]: r["label"] for r in simhash.components(simhash._links(keyed, 3)).collect()}
        assert {i: found.get(i, i) for i in range(len(prints))} == brute_components(dict(enumerate(prints)), 3)


def tasks_of(sc, first=0):
    """The stage of a job that is run now, and the tasks that ran in stages from ``first`` up to it."""
    sc.setJobGroup(group := f"mark {random.random()}", "")
    sc.parallelize([1], 1).count()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    last = max(s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds)
    return last, sum(x.numCompletedTasks for x in map(status.getStageInfo, range(first, last)) if x)


@pytest.mark.parametrize("shape", ["hub below", "hub above", "chain", "random", "none"])
def test_components_of_any_shape_in_few_tasks(spark, shape):
    """Right groups, and small tables of links are not dealt over as many tasks as a shuffle has partitions again and again."""
    rng, n, parts = random.Random(7), 400, 64
    links = {
        "hub below": [(i, 0) for i in range(1, n)],
        "hub above": [(n, i) for i in range(0, n, 2)],
        "chain": [(i + 1, i) for i in range(40)],
        "random": [(max(p), min(p)) for p in (rng.sample(range(n), 2) for _ in range(n // 2))],
        "none": [],
    }[shape]
    label = list(range(n + 1))
    for _ in range(n):
        before = label[:]
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    sc, changed = spark.sparkContext, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in changed}
    first = tasks_of(sc)[0]
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        found = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(links * 2, "a long, b long")).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == {i: x for i, x in enumerate(label) if i != x}
    tasks = tasks_of(sc, first)[1]
    assert tasks <= 16 * parts, tasks


def test_bk_tree_finds_all():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 40).repeat(30).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 1200).astype(np.uint64)))
    keys = np.r_[keys, keys[::-2], keys[:1]]  # equal ones too
    for cuts in ([0, len(keys)], [0, 1, 40, 40 + 500, len(keys)]):
        shard = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        tree = simhash.BKTrees(keys, np.array(cuts))
        for radius in (0, 3, 20):
            got = [(a, b) for x, y in tree.near(np.arange(len(keys)), radius) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
            far = np.bitwise_count(keys[:, None] ^ keys[None, :])
            want = (far <= radius) & (shard[:, None] == shard[None, :])
            assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))


def test_bk_trees_follow_only_edges_within_the_radius():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    tree, seen = simhash.BKTrees(keys, np.array([0, len(keys)])), []
    count = np.bitwise_count
    simhash.np.bitwise_count = lambda x: seen.append(len(x)) or count(x)
    try:
        list(tree.near(np.arange(100), 3))
    finally:
        simhash.np.bitwise_count = count
    assert sum(seen) < 100 * len(keys) / 3


def test_near_stage_radius(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(base if not i else base[: 30 * i] + [f"new{i}"] + base[30 * i + 1 :]), None) for i in range(6)]
    rows += [(100 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(300)), None) for i in range(30)]
    got = simhash.near_dedup(docs_of(spark, rows), 5, 24, simhash.BANDS).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 6 else i for i, _, _ in rows}


def test_near_stage_against_all_pairs(spark):
    """Edited copies of similarity 0.8 or more meet; documents that share over half of their text in a passage do not."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(90)]
    rows = [(i, " ".join([*(word() for _ in range(30)), *passage, *(word() for _ in range(30))]), None) for i in range(60)]
    for n, size in ((100, 60), (200, 300), (300, 2000)):
        base = [word() for _ in range(size)]
        for i in range(12):
            own = list(base)
            for x in rng.sample(range(size), max(1, size * i // 600)):
                own[x] = word()
            rows.append((n + i, " ".join(own), None))
    rows += [(400, None, None), (401, " ", None), (402, "Two words", None), (403, "two  words", None)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs_of(spark, rows), 5, 24, simhash.BANDS).collect()}
    grams = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        grams[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    for a in grams:
        for b in grams:
            assert got[a] == got[b] or alike(a, b) < 0.8, (a, b)
        mates = [alike(a, b) for b in grams if b != a and got[b] == got[a]]
        assert not mates or max(mates) >= 0.8, a
    assert [got[i] for i in range(60)] == list(range(60)) and got[401] == 400 and got[403] == 402


def test_near_stage_verifies_equal_fingerprints(spark):
    """A refrain repeated 200 times fixes every bit; equal fingerprints alone must not drop a document."""
    rng = random.Random(6)
    refrain = "la le li lo lu " * 200
    rows = [(i, refrain + " ".join(f"w{rng.randrange(5000)}" for _ in range(100)), None) for i in range(20)]
    rows += [(50, rows[3][1].upper().replace(" ", "  "), None)]
    got = simhash.near_dedup(docs_of(spark, rows), 5, 24, simhash.BANDS).collect()
    assert len({brute_simhash(t, 5) for _, t, _ in rows}) == 1
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 3 if i == 50 else i for i, _, _ in rows}


@pytest.mark.parametrize("crowd", [4096, 5])
def test_near_stage_threshold_is_exact(spark, monkeypatch, crowd):
    """Pairs just under a similarity of 0.8 stay apart and pairs at it link, in small and in sliced shards."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = []
    for n in range(40):
        words = [f"t{n}w{i}" for i in range(904)]
        rows += [(10 * n, " ".join(words), None), (10 * n + 1, " ".join(words[:804] + [f"n{i}" for i in range(100)]), None)]  # 800 / 1000
        words = [f"u{n}w{i}" for i in range(904)]
        rows += [(10 * n + 2, " ".join(words), None), (10 * n + 3, " ".join(words[:803] + [f"n{i}" for i in range(101)]), None)]  # 799 / 1001
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs_of(spark, rows), 5, 24, simhash.BANDS).collect()}
    tails = {i for i in got if i % 10 in (1, 3)}
    assert all(got[i] == (i - 1 if i % 10 == 1 else i) for i in tails) and all(got[i] == i for i in got if i not in tails)


def test_near_dedup_of_repeated_and_nameless_rows(spark):
    """One row of a group stays, whatever repeats; a fingerprint that only rows without a doc_id have still links."""
    words = [f"w{i}" for i in range(40)]
    chain = {1: " ".join(words), None: " ".join(["n", "m", *words[2:]]), 3: " ".join(["n", "m", *words[2:-9], "o", *words[-8:]])}
    prints = {i: brute_simhash(t) for i, t in chain.items()}
    radius = max((prints[1] ^ prints[None]).bit_count(), (prints[None] ^ prints[3]).bit_count())
    assert (prints[1] ^ prints[3]).bit_count() > radius
    rows = [(i, t, None) for i, t in chain.items()] + [(7, "own text of its own", None), (7, "own text of its own", None), (None, "x", None), (None, "x", None)]
    docs = docs_of(spark, rows)
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_dedup(docs, 3, radius).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (None, 1), (3, 1), (7, 7), (7, 7), (None, None), (None, None)], key=str)
    kept = simhash.representatives(docs, 3, radius)
    assert kept.schema == docs.schema and sorted(map(str, (tuple(r)[:2] for r in kept.collect()))) == sorted(map(str, [(1, chain[1]), (7, "own text of its own"), (None, "x")]))
    near = [(r["doc_id"], r["component_id"]) for r in simhash.near_dedup(docs.union(docs), 5, 24, simhash.BANDS).collect()]
    assert sorted(near, key=str) == sorted([(1, 1), (None, 1), (3, 3), (7, 7), (7, 7), (None, None), (None, None)] * 2, key=str)
    assert simhash.representatives(docs.union(docs), 5, 24, simhash.BANDS).count() == 4


@pytest.mark.parametrize("crowd", [4096, 6])
def test_near_stage_of_a_dense_group(spark, monkeypatch, crowd):
    """Many near copies about the threshold, a shared passage and a very long text, against all pairs; sliced shards too."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(9000)}"
    base, passage, long = [word() for _ in range(120)], [word() for _ in range(60)], [word() for _ in range(30_000)]
    rows = [(900, " ".join(long), None), (901, " ".join([*long[:29_000], "other", *long[29_000:]]), None)]
    for i in range(70):
        own = list(base)
        for x in rng.sample(range(120), rng.randint(0, 6)):
            own[x] = word()
        rows.append((i, " ".join(own), None))
    rows += [(100 + i, " ".join([*passage, *(word() for _ in range(rng.randint(5, 60)))]), None) for i in range(40)]
    grams = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t, _ in rows)}
    label = {i: i for i in grams}
    for a in sorted(grams):
        for b in sorted(grams):
            if a < b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs_of(spark, rows), 5, 24, simhash.BANDS).collect()}
    assert got == label and 1 < len(set(list(label.values())[2:72])) < 60


def test_alike_groups_against_all_pairs():
    rng = np.random.default_rng(8)
    for n in (2, 3, 60):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(0, 41), replace=False), rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)]) for _ in range(n - 1)] + [base[:0]]
        got = simhash.alike_groups(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])], np.array([simhash.fold(x) for x in sets]).view(np.uint64), 24)
        label = list(range(n))
        for i in range(n):
            for j in range(i):
                if len(np.union1d(sets[i], sets[j])) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                    label = [label[j] if x == label[i] else x for x in label]
        assert [[a == b for b in got] for a in got.tolist()] == [[a == b for b in label] for a in label]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for n, common in ((40, 30), (3000, 2400)):
        h = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
        a, b = (np.frombuffer(simhash.sketch(x), np.uint8) for x in (h[:n], h[n - common :]))
        est = ((a == b) & (a > 0)).sum() / ((a | b) > 0).sum()
        assert abs(est - common / (2 * n - common)) < 0.09
    empty = np.zeros((1, simhash.BINS), np.uint8)
    assert simhash.agree(empty, empty).all() and not simhash.agree(empty, a[None]).any()


def test_quality_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.quality(docs, labels)
    assert got.count() == docs.count()
    seen = got.where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in seen if r["quality"] == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.85
    odd = quality.quality(docs_of(spark, [(1, None, None), (2, "", None), (None, "a b", None)]), labels.where("quality = 1")).collect()
    assert {(r["score"], r["predicted"]) for r in odd} == {(0.5, 1)}
    assert quality.quality(docs_of(spark, []), labels).count() == 0


def test_language_held_out(spark):
    docs = table(spark, DATA, "documents")
    seen = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in seen) / len(seen) > 0.95
    one = docs_of(spark, [(1, "abc", None), (2, None, None), (3, "12 !", None), (4, "", None), (None, "abc", None), (5, "é", None)])
    assert {(r["doc_id"], r["lang_pred"]) for r in langid.identify(one).collect()} == {(1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "en"), (5, "en")}
    assert {r["lang_pred"] for r in langid.identify(one.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs_of(spark, [])).count() == 0


def test_code_words_differ():
    for k in (2, 3, 4, 6, 7, 30):
        code = langid.code_of(k)
        assert len({tuple(c) for c in code.tolist()}) == k and all(abs(c.sum()) < k for c in code.T)
        far = [sum(x != y for x, y in zip(a, b, strict=True)) for a, b in itertools.combinations(code.tolist(), 2)]
        assert sorted(langid.distances(code).tolist()) == sorted(far) and (k <= 6 or min(far) >= code.shape[1] / 4)


def test_decoding_by_hand():
    rng = random.Random(4)
    code = langid.code_of(5)
    for _ in range(30):
        margins = [rng.uniform(-4, 4) for _ in range(code.shape[1])]
        loss = [sum(math.log(1 + math.exp(-m * b)) for m, b in zip(margins, word, strict=True)) for word in code.tolist()]
        share = [math.exp(-x) / sum(math.exp(-y) for y in loss) for x in loss]
        assert langid.decode(np.array([margins]), code)[0].tolist() == pytest.approx(share)


def test_ftrl_by_hand():
    """Against the update rule written for one weight at a time."""
    rng = random.Random(5)
    rows = []
    for i in range(50):
        f = sorted(rng.sample(range(30), 6)) + [1 << quality.BITS]
        rows.append((np.array(f), np.array([rng.uniform(0.1, 3) for _ in f]), int(sum(f[:6]) > 90) if i % 9 else 1))
    alpha, beta, l1, l2 = 0.3, 1.0, 0.002, 0.1
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(quality.EPOCHS):
        for f, x, y in rows:
            w = {i: weight(i) for i in f.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(f.tolist(), x.tolist(), strict=True))))
            for i, v in zip(f.tolist(), x.tolist(), strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    got = quality.ftrl(rows)
    assert got[np.array(sorted(z))].tolist() == pytest.approx([weight(i) for i in sorted(z)]) and np.count_nonzero(got) <= len(z)
    right = sum((float(got[f] @ x) > 0) == y for f, x, y in rows)
    assert right >= 45


def test_ngrams_by_hand():
    """Words, pairs of words, and one feature each for a word twice in a row and with one other between."""
    rng, known = random.Random(6), {}
    texts = [" ".join(rng.choice(["ab", "cd", "é", "12", "!!", "ab12", "x-y"]) for _ in range(rng.randint(0, 25))) for _ in range(40)] + ["", " ", "a" * 70_000, "a b " * 5000]
    raw = [t.encode() for t in texts]
    f, first = quality.ngrams(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    for i, t in enumerate(texts):
        words = re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\x80-\U0010ffff\x09-\x0d ]+", t)
        want = []
        for k, w in enumerate(words):
            want.append((w,))
            if k + 1 < len(words):
                again = "next" if words[k + 1] == w else "skip" if k + 2 < len(words) and words[k + 2] == w else (w, words[k + 1])
                want.append(again)
        got = f[first[i] : first[i + 1]].tolist()
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert known.setdefault(w, g) == g
    assert len(set(known.values())) > len(known) - 3
