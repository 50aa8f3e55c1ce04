"""Operators of the write path, views, files and streams on literal cases and against loops."""

import base64
import collections
import itertools
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from memlattice.functions import text as T
from memlattice.operators import fusion, graph, lifecycle, signals, vector, views, writes
from memlattice.sources import transfer
from memlattice.sources import vectorfile
from memlattice.sources.snapshot import backup, backups, restore, verify


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_of_any_script(spark):
    assert one(spark, T.tokens(F.lit("Größe, CAFÉ niño — Łódź ñ! Ünï_code-x.y/z 42½ данные 数据库 が"))) == ["große", "cafe", "nino", "łodz", "n", "uni", "code", "x", "y", "z", "42½", "данные", "数据库", "が"]
    assert one(spark, T.query_tokens(F.lit("[pattern] RUST_REWRITE_PLAN.md 钱 数据 rust agent-core"))) == ["rust", "rewrite", "plan", "md", "数据", "agent", "core"]


def test_bm25_finds_folded_words_and_namespaces(spark):
    docs = spark.createDataFrame([(1, "Une journée d'été à la plage", "alpha"), (2, "nothing to see", "ete"), (3, "something else", "alpha")], "key long, content string, namespace string")
    q = spark.createDataFrame([(1, "ÉTÉ"), (2, "pattern"), (3, "alpha")], "query_id long, text string")
    assert rows(signals.bm25(q, docs), "query_id", "key") == [(1, 1), (1, 2), (3, 1), (3, 3)]


def test_stored_postings_score_alike(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} common text {'rare' if i == 4 else ''}", f"n{i % 2}") for i in range(9)], "key long, content string, namespace string")
    q = spark.createDataFrame([(1, "common rare", "n0"), (2, "word1", "n1"), (3, "absent", "n0")], "query_id long, text string, namespace string")
    signals.write_index(docs, str(tmp_path / "i"), ["namespace"], buckets=4)
    index = signals.read_index(spark, str(tmp_path / "i"))
    told = lambda df: sorted((r["query_id"], r["key"], round(r["score"], 9)) for r in df.collect())
    assert told(signals.bm25(q, None, same=["namespace"], index=index)) == told(signals.bm25(q, docs, same=["namespace"])) != []


def test_chinese_substrings(spark):
    docs = spark.createDataFrame([(1, "今天改版前端页面，明天上线"), (2, "前端页面没有改版"), (3, "plain"), (4, "钱")], "key long, content string")
    q = spark.createDataFrame([(1, "[pattern] 改版前端"), (2, "前端页面"), (3, "plain"), (4, "钱"), (5, "没有的")], "query_id long, text string")
    assert rows(signals.keyword_contains(q, docs), "query_id", "key") == [(1, 1), (2, 1), (2, 2), (4, 4)]


def test_distill(spark):
    short = "One! Two! Three!"
    assert one(spark, T.distill(F.lit(short))) == short
    text = "First words here! " + "Filler plain! " * 2 + "Apple apple banana! Rare thing! Apple banana cherry! Lone one! Banana apple! " + "x" * 1200 + "! The last!"
    got = one(spark, T.distill(F.lit(text)))
    assert len(got) <= 1200 and got == "First words here!Apple apple banana!Apple banana cherry!Banana apple!The last!"
    assert one(spark, T.distill(F.lit("y" * 2000))) == "y" * 1200
    assert len(one(spark, T.distill(F.lit("数据" * 400)))) == 600


def test_bytes_and_signals(spark):
    assert [one(spark, T.truncate_bytes(F.lit(t), n)) for t, n in (("héllo", 2), ("héllo", 3), ("数据库", 4), ("ab", 5), ("数", 1))] == ["h…", "hé…", "数…", "ab", "…"]
    got = one(spark, T.text_signals(F.lit("paid 12 on 2026-01-02, updated"), F.array(F.lit("signal:num:77"), F.lit("pattern"), F.lit("signal:date:2020-01-01")), F.lit("2025-05-05"), "2026-07-16T00:00:00"))
    assert got["numbers"] == ["12", "2026", "01", "02", "77"] and got["dates"] == ["2026-01-02", "2025-05-05", "2020-01-01"] and got["update_markers"] == ["updated", "supersede_chain"]


def greedy(edges, cap):
    degree, out = collections.Counter(), set()
    for ns, a, b, w in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if degree[ns, a] < cap and degree[ns, b] < cap:
            degree[ns, a] += 1
            degree[ns, b] += 1
            out.add((ns, a, b, w))
    return out


@pytest.mark.parametrize("rest", [100_000, 0])
def test_capped_graph_is_greedy(spark, monkeypatch, rest):
    monkeypatch.setattr(vector, "REST", rest)
    rng = random.Random(4)
    edges = {("n" + str(rng.randrange(2)), *sorted(rng.sample(range(25), 2))): round(rng.random(), 1) for _ in range(250)}
    edges = [(*k, w) for k, w in edges.items()]
    got = vector.capped_graph(spark.createDataFrame(edges, "namespace string, a long, b long, weight double"), 3)
    assert {tuple(r) for r in got.collect()} == greedy(edges, 3)


def loop_expand(seeds, relations, hops, fanout=10, decay=0.5):
    """Hop by hop, one frontier node and one neighbour after the other."""
    order = {t: i for i, t in enumerate(graph.FIRST)}
    near = collections.defaultdict(set)
    for s, t, kind, w in relations:
        if w > 0:
            near[s].add((order.get(kind, 3), -w, t, kind))
            near[t].add((order.get(kind, 3), -w, s, kind))
    out = []
    for q in {s[0] for s in seeds}:
        frontier = [(n, 1.0) for _, n, _ in sorted((s for s in seeds if s[0] == q), key=lambda s: (-s[2], s[1]))]
        best, seen = max(s[2] for s in seeds if s[0] == q), {n for n, _ in frontier}
        for hop in range(1, hops + 1):
            nxt = []
            for node, way in frontier:
                used = collections.Counter()
                for _, w, other, kind in sorted(near[node])[: max(3 * fanout, 20)]:
                    if other in seen:
                        continue
                    seen.add(other)
                    used[kind] += 1
                    if used[kind] <= graph.CAPS.get(kind, graph.OTHER):
                        nxt.append((other, way * -w))
                        out.append((q, other, hop, round(best * decay**hop * max(-w, 0.1), 6), round(way * -w, 6)))
            frontier = nxt
    return sorted(out)


def test_expand_against_a_loop(spark):
    rng = random.Random(6)
    kinds = ("semantic_related", "same_entity", "updates", "chronological", "derives")
    relations = list({(a, b, rng.choice(kinds), round(rng.random(), 2)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(400)) if a != b})
    seeds = [(q, n, round(rng.random(), 3)) for q in range(4) for n in rng.sample(range(60), 3)]
    got = graph.expand(spark.createDataFrame(seeds, "query_id long, node long, score double"), spark.createDataFrame(relations, "source_id long, target_id long, relation_type string, weight double"), 3)
    assert sorted((r["query_id"], r["node"], r["hop"], round(r["score"], 6), round(r["graph"], 6)) for r in got.collect()) == loop_expand(seeds, relations, 3)


def test_pairs_of_hot_keys(spark):
    m = [(k, i) for k in ("hot", "cold") for i in range(60 if k == "hot" else 4)]
    got = graph.pairs_of(spark.createDataFrame(m, "k string, i long"), "k", "i", lot=7)
    assert rows(got, "k", "a", "b") == sorted([("hot", a, b) for a, b in itertools.combinations(range(60), 2)] + [("cold", a, b) for a, b in itertools.combinations(range(4), 2)], key=str)


def test_jaccard_pairs_against_all_pairs(spark):
    rng = random.Random(7)
    sets = {k: set(rng.sample("abcdefghij", rng.randint(1, 8))) for k in range(60)}
    got = graph.jaccard_pairs(spark.createDataFrame([(k, w) for k, s in sets.items() for w in s], "k long, w string"), 0.6)
    assert rows(got, "a", "b") == sorted([(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])], key=str)


@pytest.mark.parametrize("earlier", [False, True])
def test_knn_within_namespaces(spark, earlier):
    rng = random.Random(8)
    v = [(i, [rng.gauss(0, 1) for _ in range(5)], "hot" if i % 3 else f"n{i % 7}") for i in range(150)]
    df = spark.createDataFrame(v, "key long, v array<double>, namespace string")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = set()
    for i, a, n in v:
        near = sorted((-round(cos(a, b), 6), j) for j, b, m in v if m == n and (not earlier or j < i))[:3]
        want |= {(i, j) for _, j in near}
    q = df.withColumnRenamed("key", "query_id")
    assert set(rows(vector.knn(q, df, 3, same=["namespace"], earlier=earlier), "query_id", "key")) == want
    many = {(i, j) for i, a, n in v for j, b, m in v if m == n and (not earlier or j < i) and cos(a, b) >= 0.5}
    assert set(rows(vector.knn(q, df, None, same=["namespace"], earlier=earlier, least=0.5), "query_id", "key")) == many


def test_import_by_line(spark):
    row = lambda **r: json.dumps({"table": "memories", "row": {"id": "a", "namespace": "n", **r}})
    lines = [row(), row(id="b"), row(namespace="m"), "{oops", '{"row": {}}', '{"table": "memories"}', '{"table": "pets", "row": {"namespace": "n"}}', "  "]
    df, old = spark.createDataFrame([(x,) for x in lines], "value string"), {"memories": spark.createDataFrame([("a",)], "id string")}
    assert rows(transfer.import_lines(df, "n", old), "action") == sorted(["ignored", "inserted", "ns mismatch", "parse error", "missing table", "missing row", "unknown table"])
    assert "replaced" in rows(transfer.import_lines(df, "n", old, "replace"), "action")
    transfer.check_header('{"version": 1}')
    for bad in ("x", "{}", '{"version": 2}'):
        with pytest.raises(ValueError, match="header|version"):
            transfer.check_header(bad)


def test_export_lines(spark):
    v = spark.createDataFrame([("a", "n", [1.0, 2.0])], "id string, namespace string, vector array<float>")
    m = spark.createDataFrame([("a", "n", "text", 1)], "id string, namespace string, content string, secret int")
    first, *rest = [json.loads(r["value"]) for r in transfer.export_lines({"memories": m, "memory_vectors": v, "pets": m}).collect()]
    assert first == {"version": 1, "counts": {"memories": 1, "memory_vectors": 1}}
    assert rest[0] == {"table": "memories", "row": {"id": "a", "namespace": "n", "content": "text"}}
    assert struct.unpack("<2f", base64.b64decode(rest[1]["row"]["vector"])) == (1.0, 2.0)
    assert transfer.export_lines({"memories": m, "memory_vectors": v}, include_vectors=False).count() == 2


def test_backups(spark, tmp_path):
    base = str(tmp_path / "b")
    m = spark.range(5).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
    for day in ("2026-06-01", "2026-06-02", "2026-06-08"):
        backup(spark, {"memories": m}, base, day)
    assert rows(backups(spark, base), "day", "tier") == [("2026-06-01", "monthly"), ("2026-06-02", "daily"), ("2026-06-08", "weekly")]
    assert rows(verify(spark, base, "2026-06-02"), "table", "ok") == [("memories", True)]
    assert restore(spark, base, "2026-06-02", "memories").count() == 5
    spark.range(3).withColumn("text", F.lit("x")).write.mode("overwrite").parquet(f"{base}/day=2026-06-02/memories")
    assert rows(verify(spark, base, "2026-06-02"), "table", "ok") == [("memories", False)]
    with pytest.raises(ValueError, match="broken"):
        restore(spark, base, "2026-06-02", "memories")
    backup(spark, {"memories": m}, base, "2026-06-09", keep={"daily": 1, "weekly": 1, "monthly": 1})
    assert rows(backups(spark, base), "day") == ["2026-06-01", "2026-06-08", "2026-06-09"]


def test_vector_files(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("bé", [3.0, 4.0])], "id string, v array<double>").coalesce(1)
    vectorfile.save(v, str(tmp_path / "v"), 2)
    assert rows(vectorfile.load(spark, str(tmp_path / "v"), 2), "id", "v") == [("a", [1.0, 2.0]), ("bé", [3.0, 4.0])]
    (tmp_path / "bad.bin").write_bytes(b"\x05\x00\x00\x00junk")
    assert [r["error"] is not None for r in vectorfile.load(spark, str(tmp_path / "bad.bin"), 2).collect()] == [True]


def test_embedding_and_scoring_hooks(spark):
    df = spark.createDataFrame([(1, "aa"), (2, ""), (3, "bbbb")], "key long, content string")
    got = writes.embed(df, lambda s: s.map(lambda t: [float(len(t)), 0.0]), 2)
    assert rows(got, "key", "v") == [(1, [1.0, 0.0]), (3, [1.0, 0.0])]
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, key long, rank int")
    texts = spark.createDataFrame([(1, 10, "q", "x"), (1, 11, "q", "xxx"), (1, 12, "q", "")], "query_id long, key long, q_text string, content string")
    out = views.score_by(results, texts, lambda q, c: c.map(lambda t: float("nan") if t == "" else len(t)))
    assert rows(out, "rank", "key") == [(1, 11), (2, 10), (3, 12)]


def test_drawn_graph_falls_back_to_keywords(spark):
    nodes = spark.createDataFrame([("n", 1, "数据库备份"), ("n", 2, "数据库备份了"), ("n", 3, "完全不同"), ("m", 4, "数据库备份")], "namespace string, key long, content string")
    rel = spark.createDataFrame([(1, 3, "updates", 0.01), (3, 1, "updates", 7.0), (1, 4, "updates", 1.0)], "source_id long, target_id long, relation_type string, weight double")
    assert rows(views.drawn_graph(nodes, rel), "namespace", "a", "b", "relation_type", "weight") == [("n", 1, 2, "keyword", 0.75), ("n", 1, 3, "updates", 1.0)]


def test_orphans_are_refused_when_many(spark):
    v, m = spark.range(10).withColumnRenamed("id", "key"), spark.range(7).withColumnRenamed("id", "key")
    assert lifecycle.remove_orphans(v, m).count() == 7
    with pytest.raises(ValueError, match="more than 2"):
        lifecycle.remove_orphans(v, m, 2)


def test_pending_rows_weigh_less(spark):
    from memlattice.plans.hybrid import Params

    assert Params("2024-01-01").pending_weight == 1.0
    sig = spark.createDataFrame([(1, "keyword", 5, 1.0, 60), (1, "semantic", 5, 1.0, 3), (1, "temporal", 6, 1.0, 0)], "query_id long, channel string, key long, score double, rank int")
    assert rows(fusion.rrf(sig), "key", "main_rank") == [(5, 3), (6, None)]


def test_distances(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vector.hamming(arr(1, 2, 3, 4), arr(1, 0, 3, 0))) == 0.5
    p, q = arr(0.5, 0.5), arr(1.0, 0.0)
    assert abs(one(spark, vector.jensen_shannon(p, q)) - 0.46450140402) < 1e-9


def test_audit_stream_is_masked(spark, tmp_path):
    from memlattice.streaming.ingest import start_audit

    source = str(tmp_path / "in")
    spark.createDataFrame([("2026-01-05 10:00:00", '{"token": "abcdefgh"}')], "at string, params string").select(F.to_timestamp("at").alias("ts"), "params").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, params string").parquet(source)
    start_audit(stream, str(tmp_path / "audit"), str(tmp_path / "c2")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "audit"))
    assert rows(out, "params") == ['{"token": "abcd****"}'] and rows(out, "iso_week") == ["2026w02"]


def test_office_and_pdf_files(spark, tmp_path):
    import zipfile
    import zlib

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>")
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c><v>4</v></c></row></sheetData></worksheet>')
    page = zlib.compress(rb"BT /F1 12 Tf 10 20 Td (Hello \(PDF\)) Tj 0 -14 Td [(Wor) -20 (ld)] TJ T* <41 42> Tj T* (And as much more text as a page that was not scanned has.) Tj ET")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Length " + str(len(page)).encode() + b" /Filter /FlateDecode >>\nstream\n" + page + b"\nendstream endobj")
    (tmp_path / "d.txt").write_text("plain")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.xls").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"] is not None) for r in transfer.extract_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.docx": ("Hello there\n\nEnd", False), "b.xlsx": ("# sheet1\nname\t4", False), "c.pdf": ("Hello (PDF)\nWorld\nAB\nAnd as much more text as a page that was not scanned has.", False), "d.txt": ("plain", False), "e.docx": (None, True), "f.xls": (None, True)}


def test_occurred_tags_and_aliases(spark):
    tags = F.array(F.lit("a"), F.lit("occurred:2020-01-01"))
    assert one(spark, T.with_occurred(tags, F.lit("2026-02-03T10:00"))) == ["a", "occurred:2026-02-03"] and one(spark, T.with_occurred(tags, F.lit("soon"))) == ["a", "occurred:2020-01-01"]
    e = spark.createDataFrame([("Ann", "annie", None), ("Bob", None, "likes ann"), ("Cy", None, None), ("Di", None, None)], "entity string, aliases string, summary string")
    m = spark.createDataFrame([("Cy", "with Ann"), ("Cy", "x"), ("Di", "y")], "entity string, context string")
    assert rows(graph.entity_search(e, m, "ann"), "rank", "entity", "mentions_count") == [(1, "Cy", 2), (2, "Ann", 0), (3, "Bob", 0)]


def test_quota_windows_of_a_stream(spark, tmp_path):
    from memlattice.streaming.ingest import quota_counts

    source = str(tmp_path / "in")
    spark.sql("select timestamp'2026-01-01 10:00:05' ts, 'n' ns, 'search' kind union all select timestamp'2026-01-01 10:00:50', 'n', 'search' union all select timestamp'2026-01-01 12:00:00', 'n', 'search'").write.parquet(source)
    stream = quota_counts(spark.readStream.schema("ts timestamp, ns string, kind string").parquet(source))
    stream.writeStream.format("memory").queryName("quotas").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert rows(spark.table("quotas"), "n") == [2]
