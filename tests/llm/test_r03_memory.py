"""A worker's memory in the stages of the pipeline."""

import tracemalloc

import numpy as np
import pyarrow as pa

from memlattice.llm import jaccard_join, kernels, quality
from memlattice.llm.common import give_back
from memlattice.llm.source_mix import mix


def _most(run):
    tracemalloc.start()
    out = run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_a_worker_keeps_no_tables():
    kernels.powers(kernels.BASE, 1 << 21)
    give_back()
    assert not kernels._powers


def test_trigrams_take_no_table():
    """A table of all trigrams would be 32 MB, and stay in the worker."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(32, 400, n))) for n in (300_000, 0, 1, 2, 3, 200_000)]
    column = pa.array(texts)
    (bucket, offs), most = _most(lambda: quality._trigrams(column))
    assert most < 24 << 20
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
        code = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16) if len(raw) > 2 else raw[:0]
        assert (bucket[offs[i] : offs[i + 1]] == kernels.mix(code) % np.uint64(quality.BUCKETS)).all()


def test_entries_are_sorted_in_bounded_memory():
    """One column at most is held twice, in both products."""
    rng = np.random.default_rng(6)
    n = 1_000_000
    h, ids, sizes = rng.integers(0, 300_000, n).astype(np.uint64), rng.integers(0, 9000, n), np.full(n, 100, np.int32)
    size = h.nbytes + ids.nbytes + sizes.nbytes
    blob = pa.RecordBatch.from_pydict({"block": [0] * 4, "blob": [kernels.pack(*(c[i::4] for c in (h.view(np.int64), ids, sizes))) for i in range(4)]})
    got, most = _most(lambda: list(jaccard_join._counts(8)(iter([blob]))))
    assert most < 3.6 * size
    rows = [kernels.unpack(b, 4) for b in got[0].column("blob").to_pylist()]
    found = np.concatenate([r[0] for r in rows])
    values, count = np.unique(h, return_counts=True)
    assert (np.sort(found) == np.repeat(values[count > 1], count[count > 1]).astype(np.int64)).all()
    assert all((r[3] == count[np.searchsorted(values, r[0].astype(np.uint64))]).all() for r in rows)


def test_rows_of_the_driver_start_no_other_workers(spark, monkeypatch):
    """parallelize() would make Python workers beside those of Arrow, and executors keep both."""
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad bad zzz qqq ") * 9, None if i % 5 == 0 else "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    ratings, unrated = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) grade"), docs.selectExpr("doc_id", "cast(null as int) grade")

    def parallelize(*_):
        raise AssertionError("rows went through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    assert all(r["keep"] == bool(r["doc_id"] % 2) for r in quality.quality(docs, ratings).collect())
    assert all(r["keep"] for r in quality.quality(docs, unrated).collect())
    mixed = mix(docs).collect()
    assert len(mixed) == 40 and {r["source"] for r in mixed} == {None, "a", "b"}
    assert mix(docs.filter("doc_id < 0")).collect() == []
