from pyspark.sql import functions as F

from memlattice.functions import temporal as TM
from memlattice.functions import text as T
from memlattice.operators import graph, lifecycle, vector
from memlattice.sources import transfer
from memlattice.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_signals_of_a_text(spark):
    text = F.lit("2026-07-01 paid 120 then 2026/07/02")
    assert "120" in one(spark, T.numbers(text)) and "2026" in one(spark, T.numbers(text))
    assert one(spark, T.dates(text)) == ["2026-07-01", "2026-07-02"]


def test_relative_dates(spark):
    said = lambda text: one(spark, T.relative_dates(F.lit(text), "2026-07-16"))
    assert said("上周三 yesterday") == ["2026-07-06", "2026-07-08"] and said("昨天") == ["2026-07-15"] and said("这周五") == ["2026-07-13", "2026-07-17"]
    assert said("上个月、下月、去年") == ["2026-06-01", "2026-08-01", "2025-01-01"]


def test_markers_advice_and_names(spark):
    assert one(spark, T.update_markers(F.lit("Previously changed; 目前"))) == ["目前", "changed", "previously"]
    assert one(spark, T.guardrails(F.lit("How many items before?"))) == ["COUNT_TOTAL_DEDUP", "RELATIVE_DATE_GROUNDING", "CURRENT_PREVIOUS_ARBITRATION"]
    assert one(spark, T.cjk_shingles(F.lit("ab 数据库 x 数据"))) == ["数据", "据库", "数据库"]
    assert [one(spark, T.memory_relation(F.lit(x).cast("string"))) for x in (" Extend", None, "banana")] == ["extends", "updates", None]
    assert one(spark, T.safe_filename(F.lit("a/b c.pdf"))) == "b_c.pdf" and one(spark, T.ns_folder(F.lit("agent/x y\\z"))) == "agent_xy_z"
    assert one(spark, T.signal_tags(F.array(F.lit("a"), F.lit("signal:num:9")), F.lit("2026-07-01 paid 120, updated"))) == ["a", "signal:num:2026", "signal:num:07", "signal:num:01", "signal:num:120", "signal:date:2026-07-01", "signal:update:updated"]
    assert one(spark, T.evolved_context(F.lit("  "))) == "[auto-promoted] (no content)"
    assert one(spark, T.keyword_query(F.lit(" a  b "), F.array(F.lit(" ")))) == "a b"


def test_chunks_overlap(spark):
    parts = one(spark, T.chunk_text(F.lit("x" * 8000)))
    assert [len(p) for p in parts] == [3500, 3500, 1400]
    assert one(spark, T.chunk_text(F.lit(""))) == [""]


def test_kind_and_masks(spark):
    assert [one(spark, T.detect_kind(F.lit(n))) for n in ("a.PDF", "b.docx", "c.xlsx", "d.xls", "e.txt")] == ["pdf", "docx", "xlsx", "xls", None]
    assert one(spark, T.mask_secrets(F.lit('{"x_token": "abcdefgh", "n": {"password": "abc"}, "a": "b"}'))) == '{"x_token": "abcd****", "n": {"password": "****"}, "a": "b"}'
    assert one(spark, T.mask_secrets(F.lit("password=hunter22, secret:ab c"))) == "password=hunt****, secret:**** c"
    assert one(spark, T.occurred(F.array(F.lit("x"), F.lit("occurred:2026-01-02")))) == "2026-01-02"


def test_as_of_versions(spark):
    rows = spark.createDataFrame([("m1", "2025-01-01T00:00:00", "2025-12-31T23:59:59"), ("m2", "2026-01-01T00:00:00", None)], "id string, f string, t string")
    at = lambda when: [r["id"] for r in rows.filter(TM.valid_at(F.col("f"), F.col("t"), when)).collect()]
    assert at("2025-06-01") == ["m1"] and at("2026-06-01") == ["m2"]


def test_closing_time(spark):
    close = lambda to, new: one(spark, TM.closing_time(F.lit(to).cast("string"), F.lit(new).cast("string"), "2026-08-01"))
    assert close(None, "2026-07-01") == "2026-07-01" and close("2020-06-01", None) == "2020-06-01" and close("", None) == "2026-08-01"


def test_near_duplicates_threshold(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.5, 0.866], "a"), (4, [1.0, 0.0], "b"), (5, [0.0, 0.0], "a")], "key long, v array<double>, ns string")
    assert [(r["old"], r["new"]) for r in vector.near_duplicates(v, same=["ns"]).collect()] == [(1, 2)]


def test_quota_and_links(spark):
    r = spark.createDataFrame([("n", "write", f"2026-01-01 00:00:0{i}", i) for i in range(5)], "ns string, kind string, ts string, key int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [x["admitted"] for x in lifecycle.quota_admission(r, 3, "1 minute").orderBy("key").collect()] == [True] * 3 + [False] * 2
    e = spark.createDataFrame([(1, 1), (1, 2)], "source_id int, target_id int")
    assert {x["node"]: x["links"] for x in graph.link_counts(e).collect()} == {1: 2, 2: 1}


def test_turtle():
    text = '@prefix e: <http://x/> . e:a e:supersedes e:b , e:c ; e:label "no" ; <http://x/deep/partOf> e:z . # end\n<http://x/d> e:partOf _:n .'
    assert transfer.parse_turtle(text, ("http://x/",)) == [("http://x/a", "supersedes", "http://x/b"), ("http://x/a", "supersedes", "http://x/c"), ("http://x/d", "part_of", "_:n")]


def test_expansion(spark):
    seeds = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.2)], "query_id long, node long, score double")
    rel = spark.createDataFrame([(10, 20, "updates", 0.8), (20, 30, "same_entity", 0.5), (10, 40, "updates", -1.0)], "source_id long, target_id long, relation_type string, weight double")
    got = {r["node"]: (r["hop"], round(r["score"], 6), round(r["graph"], 6)) for r in graph.expand(seeds, rel, 2).collect()}
    assert got == {20: (1, 0.2, 0.8), 30: (2, 0.0625, 0.4)}


def test_session_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"role": "user", "content": "hi"}\nbad\n{"role": "assistant", "content": "no"}\n{"role": "user", "content": "hi"}\n')
    stream = ingest.observations(ingest.session_lines(spark, str(tmp_path / "in")))
    ingest.start_append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["hi"]
