"""Ranked lexical search by three-phase uniform thresholds (TPUT) over postings partitioned by term.

Whole texts are tokenised once. A block of some hundred documents gives one row for each term that a query may have (a bitmap of fixed size
says which; a false alarm costs rows, not answers) and one row with its ids and lengths. The rows are written dealt by term, so a list's parts lie together.

1. Each list gives the k entries of largest contribution. Their sums for each query and document are lower bounds, the k-th
   largest of them is the query's first bound.
2. A k-th of the answer that no list has shown would have less than bound / terms in each list; so each list gives all entries of that
   size, uniformly for the query's lists (a list asked by several queries takes the least of their thresholds, once). Their
   sums give the second bound. A document whose sum, plus the threshold for each list that has not shown it, is under that bound is out.
3. What is left is looked up in the lists under their thresholds, and the exact sums are ranked.

Entries travel packed by list and block and are summed as arrays of queries by documents of one block. Queries are taken in batches of bounded
size, and a batch's terms and thresholds go to the tasks as a file of that bounded size would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, in_arrow, n_parts
from .kernels import LOWER, chunks, span_hashes, text_bytes, word_spans

#: Documents of a block at most, and queries and their terms of a batch (a single query with more terms is a batch of its own).
DOCS, ITEMS, PAIRS = 1024, 512, 1 << 17
#: Bits of the bitmap of query terms.
BITMAP = 1 << 20
#: Parts that a list's blocks are dealt into.
LIST_PARTS = 16

#: Bytes between the terms: ASCII but for digits and letters.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
for _a, _b in ("09", "AZ", "az"):
    _BETWEEN[ord(_a) : ord(_b) + 1] = False

_LISTS = "block long, term long, docs array<int>, tfs array<int>, ns array<int>, ids array<long>"
_lists = pa.schema([("block", pa.int64()), ("term", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("docs", "tfs", "ns")), ("ids", pa.list_(pa.int64()))])


def _terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms of a text column, and for each text the index of its first."""
    buf, offs = text_bytes(col)
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs, _BETWEEN)
    return span_hashes(buf, starts, ends).view(np.int64), first


def _split(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """A list column of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _postings(bitmap: np.ndarray):
    """Rows of a block: one without a term with its documents' ids and lengths, and one for each term of the bitmap with documents and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, named = TaskContext.get().partitionId() << 32, np.unpackbits(bitmap).astype(bool)
        for batch in batches:
            for chunk in chunks(batch):
                for at in range(0, chunk.num_rows, DOCS):
                    part = chunk.slice(at, DOCS)
                    words, first = _terms(part.column("text"))
                    n = np.diff(first)
                    doc = np.repeat(np.arange(len(n)), n)
                    asked = named[words & (BITMAP - 1)]
                    words, doc = words[asked], doc[asked]
                    names, code = np.unique(words, return_inverse=True)
                    key, tf = np.unique(code * len(n) + doc, return_counts=True)
                    sizes = np.bincount(key // len(n), minlength=len(names)) if len(names) else np.zeros(0, np.int64)
                    docs = (key % len(n)).astype(np.int32)
                    ids = part.column("doc_id")
                    none = np.zeros(len(names), np.int64)
                    columns = [
                        pa.array(np.full(len(names) + 1, number)),
                        pa.array([None, *names.tolist()], pa.int64()),
                        _split(docs, np.concatenate([[0], sizes])),
                        _split(tf.astype(np.int32), np.concatenate([[0], sizes])),
                        _split(np.concatenate([n, n[docs]]).astype(np.int32), np.concatenate([[len(n)], sizes])),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0, len(n)], len(n) + none]).astype(np.int32)), ids),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=_lists)
                    number += 1

    return run


def _query_terms() -> object:
    """(item_id, term) of each different term of a query text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words, first = _terms(part.column("text"))
                item = part.column("item_id").take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(first))))
                yield pa.RecordBatch.from_arrays([item, pa.array(words)], names=["item_id", "term"])

    return run


@dataclass
class Asked:
    """A batch of queries: terms by hash with their weight and threshold, and for each term the queries that have it."""

    terms: np.ndarray
    weights: np.ndarray
    least: np.ndarray
    items: int
    item: np.ndarray
    first: np.ndarray
    docs: int
    tokens: int

    def contributions(self, at: int, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n.astype(np.int64) * self.docs) // self.tokens
        tf = tf.astype(np.int64)
        return self.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))

    def place(self, term: int) -> int:
        at = int(np.searchsorted(self.terms, term))
        return at if at < len(self.terms) and self.terms[at] == term else -1


def _lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Block, term and the arrays of each row."""
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        flat, offs = {}, {}
        for c, col in columns.items():
            if pa.types.is_list(col.type):
                flat[c] = col.flatten().to_numpy(zero_copy_only=False)
                offs[c] = np.concatenate([[0], np.cumsum(np.nan_to_num(np.asarray(col.value_lengths().fill_null(0))))]).astype(np.int64)
        block, term = columns["block"].to_pylist(), columns["term"].to_pylist()
        for i in range(batch.num_rows):
            yield block[i], term[i], {c: flat[c][offs[c][i] : offs[c][i + 1]] for c in flat}


def _best(k: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The rows with the k largest values of the first array, all that tie with the last of them."""
    first = arrays[0]
    if len(first) > k:
        keep = first >= np.partition(first, -k)[-k]
        return [a[keep] for a in arrays]
    return list(arrays)


def _heads(asked: Asked, k: int):
    """(term, block, doc, c): k entries of largest contribution of each list, as far as a task has it; rows come by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def emit() -> Iterator[pa.RecordBatch]:
            if held is not None and len(held[0]):
                c, block, doc = (a[:k] for a in (x[np.lexsort((held[2], held[1], -held[0]))] for x in held))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), now)), pa.array(block), pa.array(doc.astype(np.int32)), pa.array(c)], names=["term", "block", "doc", "c"])

        for block, term, row in _lists_of(batches):
            if term is None or (at := asked.place(term)) < 0:
                continue
            if term != now:
                yield from emit()
                now, held = term, None
            c = asked.contributions(at, row["tfs"], row["ns"])
            got = _best(k, c, np.full(len(c), block), row["docs"].astype(np.int64))
            held = got if held is None else _best(k, *(np.concatenate(x) for x in zip(held, got, strict=True)))
            if len(held[0]) > 4 * k:  # copies tie
                held = [x[np.lexsort((held[2], held[1], -held[0]))[:k]] for x in held]
        yield from emit()

    return run


_SENT = "block long, term long, docs array<int>, cs array<long>, ids array<long>"
_sent = pa.schema([("block", pa.int64()), ("term", pa.int64()), ("docs", pa.list_(pa.int32())), ("cs", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])


def _over(asked: Asked):
    """Each list's entries at or over its threshold, and the rows of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for block, term, row in _lists_of(batches):
            if term is None:
                out.append((block, None, None, None, row["ids"]))
            elif (at := asked.place(term)) >= 0:
                c = asked.contributions(at, row["tfs"], row["ns"])
                keep = c >= max(1, asked.least[at])
                if keep.any():
                    out.append((block, term, row["docs"][keep], c[keep], None))
            if len(out) >= 1000:
                yield _sent_rows(out)
                out = []
        if out:
            yield _sent_rows(out)

    return run


def _sent_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _sent, strict=True)], schema=_sent)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list]]:
    """Block, ids and the term rows of each block; rows come by block."""
    now, ids, rows = None, None, []
    for block, term, row in _lists_of(batches):
        if block != now:
            if ids is not None:
                yield now, ids, rows
            now, ids, rows = block, None, []
        if term is None:
            ids = row["ids"]
        else:
            rows.append((term, row["docs"], row["cs"]))
    if ids is not None:
        yield now, ids, rows


def _sums(asked: Asked, rows: list, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of queries by documents: the sum of the entries shown, and what the lists that showed none may add."""
    total = np.zeros((asked.items, docs), np.int64)
    unseen = np.maximum(asked.least - 1, 0)
    each = np.bincount(asked.item, np.repeat(unseen, np.diff(asked.first)), asked.items).astype(np.int64)
    may = np.repeat(each[:, None], docs, axis=1)
    for term, doc, c in rows:
        at = asked.place(term)
        cells = np.ix_(asked.item[asked.first[at] : asked.first[at + 1]], doc)
        total[cells] += c
        may[cells] -= unseen[at]
    return total, may


def _second_bounds(asked: Asked, k: int):
    """(item, score): the k largest sums of each query in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, bound = [np.zeros(0, np.int64)] * asked.items, np.ones(asked.items, np.int64)
        for _, ids, rows in _blocks_of(batches):
            total = _sums(asked, rows, len(ids))[0]
            for q in np.flatnonzero((total >= bound[:, None]).any(axis=1)).tolist():
                best[q] = np.sort(np.concatenate([best[q], total[q][total[q] >= bound[q]]]))[::-1][:k]
                bound[q] = max(1, best[q][-1]) if len(best[q]) == k else 1
        sizes = [len(x) for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(asked.items), sizes).astype(np.int32)), pa.array(np.concatenate(best))], names=["item", "score"])

    return run


def _wanted(asked: Asked, bounds: np.ndarray):
    """(block, term, docs): the documents of a block that are looked up in a list, for any query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, rows in _blocks_of(batches):
            total, may = _sums(asked, rows, len(ids))
            # a query of which less than k documents were shown has the bound 1
            left = total + may >= bounds[:, None]
            shown = dict.fromkeys(asked.terms.tolist())
            shown |= {term: doc for term, doc, _ in rows}
            out = []
            for at, (term, doc) in enumerate(shown.items()):
                if asked.least[at] > 1:
                    want = left[asked.item[asked.first[at] : asked.first[at + 1]]].any(axis=0)
                    if doc is not None:
                        want[doc] = False
                    if want.any():
                        out.append((block, term, np.flatnonzero(want).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.list_(pa.int32()))], names=["block", "term", "docs"])

    return run


def _looked_up(asked: Asked):
    """The entries of a list for the documents that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for block, term, row in _lists_of(batches):
            at = asked.place(term)
            here = np.isin(row["docs"], row["wanted"], assume_unique=True)
            if here.any():
                out.append((block, term, row["docs"][here], asked.contributions(at, row["tfs"][here], row["ns"][here]), None))
            if len(out) >= 1000:
                yield _sent_rows(out)
                out = []
        if out:
            yield _sent_rows(out)

    return run


def _answers(asked: Asked, bounds: np.ndarray, k: int):
    """(item, doc_id, score): the k best of each query in a task by exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((2, 0), np.int64)] * asked.items
        floor = np.maximum(bounds, 1)
        for _, ids, rows in _blocks_of(batches):
            total, _ = _sums(asked, rows, len(ids))
            for q in np.flatnonzero((total >= floor[:, None]).any(axis=1)).tolist():
                here = np.flatnonzero(total[q] >= floor[q])
                held = np.concatenate([best[q], [total[q][here], ids[here]]], axis=1)
                best[q] = held = held[:, np.lexsort((held[1], -held[0]))[:k]]
                if held.shape[1] == k:
                    floor[q] = max(floor[q], held[0, -1])
        sizes = [x.shape[1] for x in best]
        score, doc = np.concatenate(best, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(asked.items), sizes).astype(np.int32)), pa.array(doc), pa.array(score)], names=["item", "doc_id", "score"])

    return run


def _batch(asks: DataFrame, lists: DataFrame, weights: DataFrame, docs: int, tokens: int, k: int) -> DataFrame:
    """(item_id, doc_id, score) of the k best for each query of one batch; asks is (item_id, term)."""
    spark, p = lists.sparkSession, n_parts(lists.sparkSession)
    pairs = asks.join(weights, "term").filter("w > 0").collect()  # PAIRS at most, or one query
    if not pairs:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    names = sorted({r["item_id"] for r in pairs}, key=lambda x: (x is not None, x or 0))
    number = {x: i for i, x in enumerate(names)}
    terms = np.unique(np.array([r["term"] for r in pairs], np.int64))
    at = np.searchsorted(terms, np.array([r["term"] for r in pairs], np.int64))
    order = np.argsort(at, kind="stable")
    items = np.array([number[r["item_id"]] for r in pairs], np.int64)[order]
    first = np.searchsorted(at[order], np.arange(len(terms) + 1))
    w = np.zeros(len(terms), np.int64)
    w[at] = [r["w"] for r in pairs]
    asked = Asked(terms, w, np.zeros(len(terms), np.int64), len(names), items, first, docs, tokens)

    known = spark.createDataFrame([(int(t), int(q)) for i, t in enumerate(terms.tolist()) for q in items[first[i] : first[i + 1]]], "term long, item int")
    order_c = Window.partitionBy("term").orderBy(F.col("c").desc(), "block", "doc")
    heads = lists.transform(in_arrow, _heads(asked, k), "term long, block long, doc int, c long").withColumn("r", F.row_number().over(order_c)).filter(F.col("r") <= k)
    sums = heads.join(F.broadcast(known), "term").groupBy("item", "block", "doc").agg(F.sum("c").alias("score"))
    bounds = _kth(sums, len(names), k)
    share = np.bincount(items, minlength=len(names))
    asked.least = np.minimum.reduceat((bounds // np.maximum(share, 1))[items], first[:-1]) if len(terms) else asked.least

    over = cut(lists.transform(in_arrow, _over(asked), _SENT))
    by_block = lambda df: df.repartition(p, "block").sortWithinPartitions("block")
    second = _kth(by_block(over).transform(in_arrow, _second_bounds(asked, k), "item int, score long"), len(names), k)
    wanted = by_block(over).transform(in_arrow, _wanted(asked, second), "block long, term long, docs array<int>")
    kept = lists.filter("term is not null").select("block", "term", "docs", "tfs", "ns")
    found = kept.join(wanted.withColumnRenamed("docs", "wanted"), ["block", "term"]).transform(in_arrow, _looked_up(asked), _SENT)
    answers = by_block(over.unionByName(found)).transform(in_arrow, _answers(asked, second, k), "item int, doc_id long, score long")
    called = spark.createDataFrame([(i, x) for x, i in number.items()], "item int, item_id long")
    return answers.join(F.broadcast(called), "item").select("item_id", "doc_id", "score")


def _kth(scores: DataFrame, items: int, k: int) -> np.ndarray:
    """The k-th largest score of each query, 1 for a query with fewer."""
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))).filter(F.col("r") == k)
    out = np.ones(items, np.int64)
    for r in ranked.select("item", "score").collect():  # a row a query of the batch
        out[r["item"]] = max(1, r["score"])
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k documents of highest score above 0, equal scores by ascending doc_id.

    docs has (doc_id, text), queries has (item_id, text). Null and empty texts have no terms and are neither found nor answered; nor are
    queries whose terms no document has. Rows of one doc_id are documents of their own, with ranks of their own; a null doc_id comes first among
    equal scores. Rows of one item_id, null too, are one query with the terms of all of them. Other columns are ignored; an empty side gives no rows.
    Terms are told apart by 64-bit hashes.
    """
    spark, p = docs.sparkSession, n_parts(docs.sparkSession)
    texts = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asks = cut(texts.transform(in_arrow, _query_terms(), "item_id long, term long").distinct())
    bits = asks.select(F.col("term").bitwiseAND(F.lit(BITMAP - 1)).alias("bit")).distinct().collect()  # BITMAP rows at most
    bitmap = np.zeros(BITMAP, bool)
    bitmap[[r["bit"] for r in bits]] = True
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.transform(in_arrow, _postings(np.packbits(bitmap)), _LISTS)
    # a list's blocks are dealt into parts, so the commonest term is no task's alone; rows without a term have their block as key
    key = F.when(F.col("term").isNull(), F.xxhash64("block")).otherwise(F.xxhash64("term", F.pmod(F.xxhash64("block"), F.lit(LIST_PARTS))))
    lists = cut(rows.withColumn("_k", key).repartition(p, "_k").sortWithinPartitions("term").drop("_k"))
    with_terms = lambda x: F.size(F.filter(x, lambda n: n > 0))
    whole = lists.filter("term is null").agg(F.sum(with_terms("ns")).alias("n"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not whole["n"] or not whole["l"]:
        return empty
    df = lists.filter("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weights = cut(df.select("term", F.floor(1000 * F.log((2.0 * whole["n"] + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")).join(asks.select("term").distinct(), "term", "left_semi"))
    # batches of whole queries, by the terms of those before
    sizes = asks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    n_items, n_pairs = (x or 0 for x in sizes.agg(F.count(F.lit(1)), F.sum("n")).first())
    batches = max(1, -(-n_items // ITEMS), -(-n_pairs // PAIRS))
    out = None
    for b in range(batches):
        some = asks if batches == 1 else asks.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b)
        found = _batch(some, lists, weights, whole["n"], whole["l"], k)
        out = found if out is None else out.unionByName(found)
    place = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    doc_id = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id")
    return out.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("item_id", "rank", doc_id, "score")
