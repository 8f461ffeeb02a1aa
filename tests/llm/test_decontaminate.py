"""Decontamination beyond the broadcast bound, without ANSI mode, with names that clash, and with windows that many items hold."""

import pytest
from pyspark.sql import functions as F

from facetflow.llm import decontaminate as op
from facetflow.session import table

SF = "/root/testdata/sf0.001"
COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def data(spark):
    docs = table(spark, SF, "documents")
    some = [i.text for i in table(spark, SF, "benchmark").limit(3).collect()]
    more = [(10**6, some[0]), (10**6, some[0]), (10**6, some[1]), (None, some[2]), (10**6 + 1, "alpha beta"), (10**6 + 2, None), (10**6 + 3, "x")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("x", F.lit(1)).cache()
    bench = table(spark, SF, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text")
    short = spark.createDataFrame([("s1", "Alpha, beta"), ("s2", "alpha beta"), ("s3", "x"), ("s4", some[0]), (None, "x"), ("s5", None)], "item_id string, text string")
    return docs, bench.unionByName(short).cache()


def test_beyond_the_broadcast_bound(spark, data):
    docs, bench = data
    a, b = op.hits(docs, bench).cache(), op.hits(docs, bench, max_broadcast=0).cache()
    assert a.count() > 5 and rows(a, *a.columns) == rows(b, *b.columns)
    two = a.where("doc_id = 1000001").first()
    assert two.h_items == ["s1", "s2"] and [tuple(s) for s in two.h_spans] == [(0, 2)]
    assert not a.sparkSession.conf.get("spark.sql.ansi.enabled") == "false"


def test_without_ansi_mode(spark, data):
    docs, bench = data
    want = rows(op.report(docs, bench), *COLS)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = rows(op.report(docs, bench), *COLS)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert got == want and min(r[3] for r in got) == 0


def test_names_that_clash(spark, data):
    docs, bench = data
    clash = docs.withColumns({n: F.lit(1) for n in ("h_id", "h_key", "h_cut", "h_spans", "row", "text_key", "at", "w_id", "dw")})
    kept = op.remove_documents(clash, bench)
    cut = op.remove_spans(clash, bench).cache()
    assert kept.columns == clash.columns and kept.count() == sum(not r[-1] for r in rows(op.report(docs, bench), *COLS))
    assert cut.columns == clash.columns and cut.count() == clash.count()
    assert op.hits(cut.where("doc_id >= 1000000"), bench).count() == 0
