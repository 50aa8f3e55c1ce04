import re

from parity import SF

from memlattice.sources import adapters as A


def test_queries_keep_whole_texts(spark):
    texts = {r["item_id"]: r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {r["query_id"]: r["text"] for r in A.queries(spark, SF).collect()} == texts
    assert min(len(re.findall("[a-z0-9]+", t)) for t in texts.values()) > 6


def test_graph_keeps_every_id(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    ends = {(r[0], r[1]) for r in li.select("l_orderkey", "l_partkey").collect()}
    assert max(o for o, _ in ends) >= 1000
    assert {(r[0], r[1]) for r in A.relations(spark, SF).select("source_id", "target_id").collect()} == ends
