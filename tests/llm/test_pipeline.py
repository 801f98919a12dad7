"""The pipeline against its stages' operators, and each stage on odd rows against rows worked out by hand."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sieveline.llm import quality
from sieveline.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns, name
        assert 0 < out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.where("taken > 2 * size OR taken < size").count() == 0
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()}


SAME, LONG = "alpha beta gamma delta epsilon", " ".join(f"word{i}" for i in range(80))
#: Nulls everywhere, repeats with equal and with other texts, empty and long texts; columns that stages use themselves.
ROWS = [
    (None, None, None), (None, None, None), (1, "", None), (1, "", "s"), (2, SAME, "s"), (2, SAME, "s"), (2, "quite another text", "s"),
    (3, SAME.replace(" ", "  "), "t"), (None, SAME, "t"), (4, LONG, "t"), (5, LONG + " more", None), (5, LONG + " more", None), (6, "long " * 20_000, "s"),
]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", s, 0, n, "c", 1.5, 1, 2) for n, (i, t, s) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, copies string, `a.b` double, number int, row int").repartition(3)


def kept(spark, tmp_path, out):
    """Rows of ROWS by place, after a write, and the columns."""
    out.write.parquet(f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    rows = back.collect()
    for r in rows:
        assert (r["doc_id"], r["text"], r["source"]) == ROWS[r["size"]]
    return Counter(r["size"] for r in rows), back


def test_quality_stage_of_odd_rows(spark, odd, tmp_path):
    got, back = kept(spark, tmp_path, corpus_pipeline.quality_stage(spark, odd, DATA))
    good = Counter((r["doc_id"], r["score"] >= 0.5) for r in quality.quality(odd, table(spark, DATA, "labels")).collect())
    assert Counter(ROWS[n][0] for n in got.elements()) == Counter({i: n for (i, ok), n in good.items() if ok}) and back.columns == odd.columns


def test_exact_stage_of_odd_rows(spark, odd, tmp_path):
    got, back = kept(spark, tmp_path, corpus_pipeline.exact_stage(spark, odd, DATA))
    assert back.columns == odd.columns and max(got.values()) == 1
    groups = [{2, 3}, {7}, {6}, {9}, {10, 11}, {12}]  # of empty texts doc_id 1 stays, of SAME the longest
    assert len(got) == 6 and all(len(g & set(got)) == 1 for g in groups)


def test_near_stage_of_odd_rows(spark, odd, tmp_path):
    got, back = kept(spark, tmp_path, corpus_pipeline.near_stage(spark, odd, DATA))
    assert back.columns == odd.columns and max(got.values()) == 1
    groups = [{2, 3}, {4, 5}, {6}, {9}, {12}]
    assert len(got) == 5 and all(len(g & set(got)) == 1 for g in groups)


def test_benchmark_stage_of_odd_rows(spark, odd, tmp_path):
    item = table(spark, DATA, "benchmark").where("length(text) > 100").first()["text"]
    leaked = odd.unionByName(odd.limit(1).withColumn("text", F.lit("Before. " + item + " After.")))
    got, back = kept(spark, tmp_path, corpus_pipeline.benchmark_stage(spark, leaked, DATA))
    assert got == Counter(range(len(ROWS))) and back.columns == odd.columns


def test_mix_stage_of_odd_rows(spark, odd, tmp_path):
    out = corpus_pipeline.mix_stage(spark, odd, DATA)
    assert out.columns == [*odd.columns, "mix_size", "mix_copies", "taken"]
    got, back = kept(spark, tmp_path, out)
    assert max(got.values()) == 1
    for r in back.collect():
        size = len((r["text"] or "").split())
        assert r["mix_size"] == size and r["mix_copies"] in (1, 2) and r["taken"] == r["mix_copies"] * size


def test_stages_of_no_rows(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where(F.lit(False)), DATA).count() == 0
