"""What the findings of round 3 asked for."""

import tracemalloc

import numpy as np

from pyspark.sql import functions as F

from memlattice.llm import kernels, quality, winnowing
from memlattice.operators import vector
from memlattice.plans.catalog import text_signal_boost
from memlattice.plans.state import near_dup_writes
from memlattice.sources.adapters import vectors


def test_words_are_hashed_in_bounded_memory():
    text = b"some words of " * (1 << 19)  # the bytes of a bucket of op2
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = kernels.word_spans(buf, np.array([0, len(buf)]))
    kernels._powers.clear()
    tracemalloc.start()
    h = kernels.span_hashes(buf, starts, ends)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < h.nbytes + (24 << 20)
    assert len(set(h.tolist())) == 3
    one = [int(kernels.span_hashes(buf[s:e], np.array([0]), np.array([e - s]))[0]) for s, e in zip(starts[-3:], ends[-3:], strict=True)]
    assert h[-3:].tolist() == one


def test_boost_looks_at_a_text_once(spark):
    """No text travels with the pairs: above the last join there are only signals."""
    plan = text_signal_boost(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan.split("Join")[0]


def test_pieces_of_long_texts_meet_in_linear_time(spark):
    """Structs in array_distinct are compared pair by pair, and a look-ahead makes an object of each gram."""
    from pyspark.sql import functions as F

    from memlattice.llm import winnowing

    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    plan = docs.select(winnowing.prints(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "regexp_extract_all" not in plan


def test_quality_is_learned_in_bounded_memory():
    """The driver holds the sample and one array of its size, and learns what it did with many."""
    rng = np.random.default_rng(4)
    x = rng.poisson(0.4, (3000, quality.BUCKETS + 1)).astype(np.float32)
    y = rng.integers(0, 3, 3000)
    n = x.sum(axis=1, keepdims=True)
    usual = (x / np.maximum(n, 1)).mean(axis=0)
    plain = (x - n * usual) / (n + quality.PSEUDO)
    spread = plain.std(axis=0) + 1e-5
    kept = x.copy()
    tracemalloc.start()
    model = quality.OrdinalModel().fit(x, y, 3, steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.6 * x.nbytes
    assert (x == kept).all() and (model.spread == spread).all()


def test_tiles_are_never_broadcast(spark):
    """The queries' tiles stand in several parts, so a broadcast would bring them to the driver that many times."""
    v = vectors(spark, "/root/testdata/sf0.001").select("key", "v", "namespace")
    near = vector.knn(v.withColumnRenamed("key", "query_id"), v, 3, parts=64, earlier=True, grid=True)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_first_later_neighbour_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE", 16)
    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, (150, 4)).astype(float) + 0.25  # many equal scores
    ns = rng.integers(0, 3, 150)
    v = spark.createDataFrame([(i, r.tolist(), int(n)) for i, (r, n) in enumerate(zip(m, ns, strict=True))], "key long, v array<double>, namespace int").repartition(4)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s, want = np.round(u @ u.T, 6), {}
    for new in range(150):
        for old in sorted(range(new), key=lambda o: (-s[new, o], o))[:5]:
            if s[new, old] > 0.8 and ns[old] == ns[new]:
                want.setdefault(old, new)
    got = {r["old"]: r["new"] for r in vector.near_duplicates(v, least=0.8, topk=5, same=["namespace"]).collect()}
    assert len(want) > 50 and got == want


def test_near_dup_writes_shuffles_its_tiles(spark):
    plan = near_dup_writes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [part" not in plan and "SortMergeJoin [row" in plan


def test_quality_is_not_fitted_on_the_driver(spark, monkeypatch):
    def fit(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(quality.OrdinalModel, "fit", fit)
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad bad zzz qqq ") * 9) for i in range(40)], "doc_id long, text string")
    got = quality.quality(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) grade")).collect()
    assert all(r["keep"] == bool(r["doc_id"] % 2) for r in got)


def test_minima_are_not_looked_up_by_place(spark):
    """A look-up by place is costly for each character; windows are made of neighbouring lists instead."""
    plan = spark.sql("select 'x' as text").select(winnowing._chosen(F.col("text")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("zip_with") >= 4
    texts = ["", "abc", "abcdefgh", "a" * 50, "é" * 30 + "x", "the cat sat on the mat and the dog ran " * 4]

    def plain(text):
        grams = [text[i : i + 8] for i in range(len(text) - 7)] or ([text] if text else [])
        codes = [(h[g] << 23) | (winnowing._PLACES - i) for i, g in enumerate(grams)]
        least = [min(codes[i : i + 16]) for i in range(len(codes) - 15)] or ([min(codes)] if codes else [])
        return [c for i, c in enumerate(least) if not i or c != least[i - 1]]

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    every = {t[i : i + 8] for t in texts for i in range(max(1, len(t) - 7))}
    h = {r["g"]: r["h"] for r in spark.createDataFrame([(g,) for g in every], "g string").selectExpr("g", "shiftrightunsigned(xxhash64(g), 32) as h").collect()}
    assert {r["text"]: list(r["c"]) for r in df.select("text", winnowing._chosen(F.col("text")).alias("c")).collect()} == {t: plain(t) for t in texts}
