from memlattice.sources import transfer


def test_triples_of_whole_texts(spark):
    text = '@prefix x: <http://x/> .\nx:d1 a x:Doc ; x:partOf x:t1, x:t2 ; x:label "no" . # end'
    got = transfer.triples(spark.createDataFrame([(text,), (None,), ("",)], "value string"), ("http://x/",)).collect()
    assert sorted(map(tuple, got)) == [("http://x/d1", "part_of", "http://x/t1"), ("http://x/d1", "part_of", "http://x/t2")]
