"""Stupid-backoff scores from an n-gram count table of the whole corpus, partitioned by hash.

Documents are dealt into buckets by a hash of their row. Each bucket's distinct n-grams (orders 0 to `order`, as 64-bit hashes)
are rows with their counts there, so copies and frequent words are folded before the shuffle. They travel as sorted arrays, one for each bucket
and block of hashes, and are exploded where they arrive: the count of an n-gram is the sum over its rows (the count table and its join with the
exploded n-grams at once, as both have the same partitioning). What other buckets have goes back in the order of the hashes; there the
scores are summed for each document. A document's own counts are taken off first: it is scored by the rest of the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, n_parts
from .kernels import U64, chunks, compress, decompress, ngram_hashes, word_hashes

#: Bytes of text in a bucket. A bucket is what a worker holds at once.
BUCKET_BYTES = 7 << 20
#: Bytes of text for which there is a block of hashes, up to MANY blocks for each shuffle partition; a block is sorted by one task.
BLOCK_BYTES, MANY = 4 << 20, 4
#: Rows of n-grams that a worker holds while counts are put in the buckets' order.
LOT = 300_000
#: Orders that are counted at once; each longer one follows, as its n-grams are asked for only where the shorter ones are elsewhere.
FIRST = 2
#: The backoff factor.
ALPHA = 0.4
#: Turns the unsigned order of hashes into the signed one of SQL's longs.
_SIGN = U64(1 << 63)
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_PLANES = ("a", "b", "c", "d")
_WIDTHS = {"short": np.int16, "int": np.int32, "long": np.int64}


def _grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each word, and whether the document has it. Order 0 counts all words."""
    h = np.zeros(len(words), U64)
    if n and len(words) >= n:
        h[n - 1 :] = ngram_hashes(words, n)
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    return h, place >= n - 1


def _deal(buckets: int):
    """A row for each bucket that a batch has documents of. Repeated rows are dealt on, by what stands before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=BUCKET_BYTES):
                h = part.column("h").to_numpy().view(U64).copy()
                order = np.argsort(h, kind="stable")
                new = np.r_[True, h[order][1:] != h[order][:-1]]
                nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                h[order] += nth.astype(U64) * ((h[0] << U64(1)) | U64(1))
                bucket = (h % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(h)]
                docs = part.select(["doc_id", "text"]).take(pa.array(order))
                blobs = [compress(docs.slice(s, e - s).cast(_DOCS).serialize()) for s, e in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][edges[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "docs"])

    return run


def _bucket_words(row: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    got = [pa.ipc.read_record_batch(pa.py_buffer(decompress(b.as_py())), _DOCS) for b in row.column("docs")[0].values]
    docs = pa.Table.from_batches(got).combine_chunks()
    words, first = word_hashes(docs.column("text"))
    return docs.column("doc_id").combine_chunks(), words, first


def _told(row: pa.RecordBatch, order: int) -> dict[int, np.ndarray]:
    """For each order up to this one: how often other buckets have the bucket's n-grams, in the order of their hashes."""
    got: dict[int, list] = defaultdict(list)
    for column in row.schema.names:
        answers = row.column(column)[0].values if column != "docs" else None
        if answers is not None:
            at, of = (answers.field(c).to_numpy() for c in ("at", "n"))
            for k in np.argsort(at, kind="stable"):
                got[int(of[k])].append(next(x.values.to_numpy().astype(np.int64) for x in (answers.field(w)[int(k)] for w in _WIDTHS) if x.is_valid))
    return {n: np.concatenate(got[n]) if n in got else np.zeros(0, np.int64) for n in range(order + 1)}


def _rest(words: np.ndarray, first: np.ndarray, told: dict[int, np.ndarray], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """For each order up to this one: how often the rest of the corpus has the n-gram that ends at each word.

    From an order on that isn't told, which of them are to be asked for instead. An n-gram over FIRST is asked for only where the rest
    has both (n - 1)-grams of it: it can't be there otherwise. That depends on the document and the n-gram alone, and where two documents
    have an n-gram both ask for it.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = np.zeros(len(words), np.int64)
    for n in range(order + 1):
        h, has = _grams(words, first, n)
        if n > FIRST:
            has = has & (before > 0) & (np.r_[0, before[:-1]] > 0)
        if n not in told:
            yield n, h[has], None
            continue
        known, where, here = np.unique(h[has], return_inverse=True, return_counts=True)
        if len(told[n]) != len(known):
            raise RuntimeError("counts don't fit their bucket")
        _, back, own = np.unique(doc[has] * max(1, len(known)) + where, return_inverse=True, return_counts=True)
        before = np.zeros(len(words), np.int64)
        before[has] = (told[n] + here)[where] - own[back]
        yield n, before, has


def _tables(orders: range, blocks: int):
    """A bucket's tables of n-grams and counts, in sorted arrays for each block of hashes, split in 16-bit planes (the first hardly varies)."""
    starts = np.array([(k << 64) // blocks for k in range(blocks)], U64)

    def table(bucket: int, n: int, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, count = np.unique(h, return_counts=True)
        for once in (True, False):  # n-grams that stand there once come without counts
            g, c = h[(count == 1) == once], count[(count == 1) == once].astype(np.int32)
            edges = np.r_[np.searchsorted(g, starts), len(g)]
            some = np.flatnonzero(np.diff(edges))
            if len(some):
                offs = pa.array(np.r_[edges[some], len(g)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(np.ascontiguousarray(v))) for v in (g ^ _SIGN).view(np.int16).reshape(-1, 4).T[::-1]]
                lists.append(pa.ListArray.from_arrays(pa.array(np.zeros(len(some) + 1, np.int32)), pa.array(c[:0])) if once else pa.ListArray.from_arrays(offs, pa.array(c)))
                same = lambda v: pa.array(np.full(len(some), v, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), same(bucket), same(n), *lists], names=["block", "bucket", "n", *_PLANES, "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                bucket, row = row.column("bucket")[0].as_py(), row.drop_columns(["bucket"])
                _, words, first = _bucket_words(row)
                told = _told(row, orders[0] - 1)
                for n, h, has in _rest(words, first, told, orders[-1]):
                    if has is None:
                        yield from table(bucket, n, h)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram (and so by block) to arrays of totals for each bucket and order; `at` says where an array stands among them."""
    names = ("block", "bucket", "n", "total")

    def settle(held: list[list[np.ndarray]], seq: int) -> Iterator[pa.RecordBatch]:
        block, bucket, n, total = (np.concatenate([h[i] for h in held]) for i in range(len(names)))
        order = np.lexsort((n, bucket, block))  # stable, so the order of grams stays
        block, bucket, n, total = (c[order] for c in (block, bucket, n, total))
        new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1]) | (n[1:] != n[:-1])])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(n)].astype(np.int32)), pa.array(total))
        most, named = np.maximum.reduceat(total, new), (bucket[new], n[new], (block[new] << 24) | seq)
        least = 0
        for width, kind in _WIDTHS.items():  # each array in the narrowest integers that hold it
            at = np.flatnonzero((most >= least) & (most <= np.iinfo(kind).max))
            least = np.iinfo(kind).max + 1
            if len(at):
                held_in = [lists.take(pa.array(at)).cast(pa.list_(pa.from_numpy_dtype(k))) if w == width else pa.nulls(len(at), pa.list_(pa.from_numpy_dtype(k))) for w, k in _WIDTHS.items()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in named), *held_in], names=["bucket", "n", "at", *_WIDTHS])

    held, rows, seq = [], 0, 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in names])
        rows += batch.num_rows
        if rows >= LOT:
            yield from settle(held, seq)
            held, rows, seq = [], 0, seq + 1
    if rows:
        yield from settle(held, seq)


def _score(order: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, words, first = _bucket_words(row)
                docs, size = len(first) - 1, np.diff(first)
                longest = np.minimum(np.arange(len(words)) - np.repeat(first[:-1], size) + 1, order)
                log, shorter = np.zeros(len(words)), np.zeros(len(words), np.int64)
                for n, c, has in _rest(words, first, _told(row, order), order):
                    if n:
                        # what stands before the n-gram's last word: the (n - 1)-gram that ends one word earlier, or all words
                        before = np.r_[0, shorter[:-1]] if n > 1 else shorter
                        use = has & (c > 0) & (before > 0)  # a longer n-gram stands over a shorter one
                        log[use] = np.log(c[use] / before[use]) + (longest[use] - n) * np.log(alpha)
                    else:
                        log = -np.log(c + 1.0) + longest * np.log(alpha)
                    shorter = c
                score = np.bincount(np.repeat(np.arange(docs), size), weights=log, minlength=docs)
                mean = np.divide(score, size, out=np.zeros(docs), where=size > 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int64)), pa.array(score), pa.array(mean, mask=size == 0)], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    return run


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row of docs(doc_id, text).

    Words are lower-cased (A-Z) runs of anything but ASCII white space. A word's score is count(n-gram) / count(its first n - 1
    words) at the longest n up to `order` where the rest of the corpus has both, times alpha for each order given up; a
    word that the rest lacks scores alpha ** orders / (words of the rest + 1). log_score sums their logarithms. A
    null, empty or wordless text scores 0 with a null mean; null and repeated doc_ids are passed on, each row counts; other columns are
    ignored; an empty table gives no rows.
    """
    p = n_parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    none = rows.filter(~wordy).select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_score"), F.lit(None).cast("double").alias("mean_log_score"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    dealt = rows.filter(wordy).withColumn("h", F.xxhash64("doc_id", "text")).transform(in_arrow, _deal(buckets), "bucket long, docs binary")
    texts = dealt.groupBy("bucket").agg(F.collect_list("docs").alias("docs"))
    blocks = max(p, min(MANY * p, size // BLOCK_BYTES))
    told = texts
    for k, orders in enumerate([range(min(order, FIRST) + 1), *(range(n, n + 1) for n in range(FIRST + 1, order + 1))]):
        told = told.join(_counted(told, orders, blocks).withColumnRenamed("answers", f"a{k}"), "bucket", "left")
    scored = told.drop("bucket").transform(in_arrow, _score(order, alpha), "doc_id long, n_words long, log_score double, mean_log_score double")
    return scored.unionAll(none)


def _counted(told: DataFrame, orders: range, blocks: int) -> DataFrame:
    """(bucket, answers): how often the other buckets have the n-grams of these orders that a bucket asks for."""
    planes = ", ".join(f"{c} array<short>" for c in _PLANES)
    tables = told.transform(in_arrow, _tables(orders, blocks), f"block long, bucket long, n long, {planes}, count array<int>").repartition(blocks, "block")
    # from here on nothing is shuffled until the totals go back: sums of one block's n-grams are within its partition
    grams = tables.select("block", "bucket", "n", F.explode(F.arrays_zip(*_PLANES, "count")).alias("x"))
    low = lambda c, bits: F.shiftleft(F.col(f"x.{c}").cast("long").bitwiseAND(F.lit(65535)), bits)
    gram = F.shiftleft(F.col("x.a").cast("long"), 48).bitwiseOR(low("b", 32)).bitwiseOR(low("c", 16)).bitwiseOR(low("d", 0))
    grams = grams.select("block", "bucket", "n", gram.alias("gram"), F.coalesce("x.count", F.lit(1)).alias("count"))
    others = F.sum("count").over(Window.partitionBy("gram", "block")) - F.col("count")
    counted = grams.select("block", "bucket", "n", others.alias("total"))
    back = counted.transform(in_arrow, _totals, "bucket long, n long, at long, " + ", ".join(f"{w} array<{w}>" for w in _WIDTHS))
    return back.groupBy("bucket").agg(F.collect_list(F.struct("n", "at", *_WIDTHS)).alias("answers"))
