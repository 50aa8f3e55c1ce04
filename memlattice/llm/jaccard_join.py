"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row for each document and a column for each 5-word shingle. The join needs
the entries of M x M' that are at least 3/7 of the two rows' sizes (a similarity of 0.75). The columns are dealt
into blocks by hash. Three products follow each other, each over fewer entries:

1. Of each row only the entries with the smallest hashes go in, as many as `reach` says. The column
   blocks give each entry's column count; entries alone in their column stay behind.
2. Each row sorts its entries by column count, rarest first (entries alone in their column are rarest). A similar
   pair shares some of the first entries of both rows: of the smaller row those up to `reach - least_bound(smaller)`, of the
   larger one some more (size-derived bounds). Rows with too many entries of their own are left out; only first entries go on.
3. Rows that meet are compared on their whole texts. First each row goes to one group, that of the pivot it shares most
   entries with, and every group (in blocks of bounded size) is a small product of its own that yields a forest
   of its links. A group of several blocks is dealt twice, so that its parts meet; its rows outside its largest component then meet
   all its blocks. Then column blocks accumulate overlap counts of the pairs that are still in different components and
   groups; pairs under the bound are discarded, the others compared. So a group of copies costs blocks, not its square.

Equal rows (exact copies) are one row of the matrix, under the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, n_parts
from .graph import components, contract
from .kernels import U64, chunks, mix, pack, shingle_sets, unpack, word_hashes

#: Rows up to this size go into the first product whole, larger ones by half.
WHOLE = 256
#: Bits of a column's hash in the products. A clash adds a candidate or a count, it never loses one.
SHIFT = U64(16)
#: Entries that a worker gathers before it sends them.
HELD_ENTRIES = 1_000_000
#: Rows of a column that meet each other in one task; more are dealt into sides, which meet two at a time.
COLUMN_ROWS = 512
#: Rows, and entries of rows, in a block of a group.
BLOCK_ROWS, BLOCK_ENTRIES = 1024, 400_000


def _needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap of a row of n entries with any row that is similar to it."""
    return -(-n * num // den)


def reach(n: np.ndarray) -> np.ndarray:
    """Entries of a row of n that go into the first product."""
    return np.where(n <= WHOLE, n, (n + 1) // 2)


def _least(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of similar rows of n and m within the first product: what is beyond either reach may be missing."""
    both = -(-(n + m) * num // (num + den))
    return both - np.maximum(n - reach(n), m - reach(m))


def least_bound(n: np.ndarray, num: int, den: int, smaller: bool) -> np.ndarray:
    """Least overlap, within the first product, of a row of n with any similar row that isn't smaller (or isn't larger).

    As a function of the other size it is monotone up to WHOLE and beyond it, but for rounding: one is taken off.
    """
    low, high = (n, n * den // num) if smaller else (_needed(n, num, den), n)
    ends = [low, high, np.clip(WHOLE, low, high), np.clip(WHOLE + 1, low, high)]
    return np.maximum(np.minimum.reduce([_least(n, m, num, den) for m in ends]) - 1, 0)


def least_shared(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Entries that a similar pair shares at least among those of the second product."""
    return np.maximum(1, least_bound(n, num, den, False) // 8)


def _signature(sets: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's entries: equal rows have equal sums."""
    pref = np.zeros((2, len(sets) + 1), U64)
    np.cumsum(mix(sets), out=pref[0, 1:])
    np.cumsum(mix(sets ^ U64(0xA5A5A5A5A5A5A5A5)), out=pref[1, 1:])
    d = pref[:, offs[1:]] - pref[:, offs[:-1]]
    return d[0].view(np.int64), d[1].view(np.int64)


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets, offs = shingle_sets(*word_hashes(part.column("text")), k)
                s1, s2 = _signature(sets, offs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offs)), pa.array(s1), pa.array(s2)], names=["doc_id", "n", "s1", "s2"])

    return run


def _entries(k: int, blocks: int):
    """First product's entries, as blobs for each column block; equal rows of a chunk give theirs once."""

    def blobs(got: list[tuple]) -> pa.RecordBatch:
        columns = _joined(got)
        block = (mix(columns[0]) % U64(blocks)).astype(np.int32)
        columns[0] = columns[0].view(np.int64)
        return _blobs(block, columns)

    def entries(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = part.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        sets, offs = shingle_sets(*word_hashes(part.column("text")), k)
        s1, s2 = _signature(sets, offs)
        n = np.diff(offs)
        order = np.lexsort((ids, s2, s1, ~known))
        new = np.ones(len(order), bool)
        new[1:] = (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
        use = np.zeros(len(order), bool)
        use[order[new]] = True
        use &= known & (n > 0)
        take = np.where(use, reach(n), 0)
        doc = np.repeat(np.arange(len(n)), take)
        at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + offs[:-1][doc]
        return sets[at] >> SHIFT, ids[doc], n[doc].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            for part in chunks(batch):
                got.append(entries(part))
                held += len(got[-1][0])
                if held >= HELD_ENTRIES:
                    yield blobs(got)
                    got, held = [], 0
        if held:
            yield blobs(got)

    return run


def _joined(got: list) -> list[np.ndarray]:
    """Columns out of their pieces; got is emptied, and one column at most is held twice."""
    pieces, out = [list(x) for x in zip(*got, strict=True)], []
    got.clear()
    while pieces:
        out.append(np.concatenate(pieces[0]))
        del pieces[0]
    return out


def _take(columns: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """These rows of the columns, put in their place: one column at most is held twice."""
    for i in range(len(columns)):
        columns[i] = columns[i][at]
    return columns


def _blobs(block: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A packed blob for each block, its rows sorted by the first column; the list's columns are replaced on the way."""
    order = np.lexsort((columns[0], block))
    block = block[order]
    _take(columns, order)
    del order
    cutat = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    ends = np.r_[cutat[1:], len(block)] if len(block) else cutat
    data = [pack(*(c[a:b] for c in columns)) for a, b in zip(cutat, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[cutat].astype(np.int64)), pa.array(data, pa.binary())], names=["block", "blob"])


def _gather(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray] | None:
    got = [unpack(b.as_buffer(), columns) for batch in batches for b in batch.column("blob")]
    return _joined(got) if got else None


def _counts(blocks: int):
    """Column counts of a block; entries that are not alone in their column go on to their row's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches, 3)
        if got is None:
            return
        _take(got, np.argsort(got[0], kind="stable"))
        start = np.flatnonzero(np.r_[True, got[0][1:] != got[0][:-1]])
        count = np.diff(np.r_[start, len(got[0])]).astype(np.int32)
        got.append(np.repeat(count, count))
        _take(got, got[3] > 1)
        if len(got[0]):
            yield _blobs((mix(got[1].astype(U64)) % U64(blocks)).astype(np.int32), got)

    return run


def _rarest(num: int, den: int):
    """Each row's first entries, rarest first, if a similar row can exist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches, 4)
        if got is None:
            return
        h, ids, n = _take(got, np.lexsort((got[0], got[3], got[2], got[1])))[:3]
        start = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (n[1:] != n[:-1])])
        count = np.diff(np.r_[start, len(ids)])
        size = n[start].astype(np.int64)
        room = least_shared(size, num, den) - (reach(size) - count)  # entries alone in their column come first
        large = np.clip(reach(size) - least_bound(size, num, den, False) + room, 0, count)
        small = np.clip(reach(size) - least_bound(size, num, den, True) + room, 0, count)
        rank = np.arange(len(ids)) - np.repeat(start, count)
        keep = rank < np.repeat(large, count)
        first = (rank < np.repeat(small, count))[keep]
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(ids[keep]), pa.array(n[keep].astype(np.int32)), pa.array(first)], names=["h", "doc", "n", "first"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str, limit: int = 200_000) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no key is in two tables."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            table = pa.Table.from_batches(held)
            k = table.column(key).to_numpy()
            at = int(np.searchsorted(k, k[-1]))
            if at:
                yield table.slice(0, at)
            held, rows = table.slice(at).to_batches(), table.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _pair_rows(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    """Pairs with how often they occur; a is the smaller id."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(a)]) if len(a) else start
    return pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(na[start].astype(np.int32)), pa.array(nb[start].astype(np.int32)), pa.array(count.astype(np.int64))], names=["a", "b", "na", "nb", "shared"])


def _products(k: int, num: int, den: int):
    """Links within each block of a group, as a forest; rows come sorted by group and block."""

    def links(ids: np.ndarray, sets: np.ndarray, offs: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similar pairs of the rows that are asked for with any rows."""
        n = np.diff(offs)
        row = np.repeat(np.arange(len(ids)), n)
        _, column, count = np.unique(sets, return_inverse=True, return_counts=True)
        keep = count[column] > 1
        row, column = row[keep], column[keep]
        _, column = np.unique(column, return_inverse=True)
        rows = np.flatnonzero(np.bincount(row, minlength=len(ids)))
        begins = np.searchsorted(row, rows)
        a, b = [], []
        width = int(np.clip(8_000_000 // max(1, len(row)), 1, 64))
        asked = rows[asked[rows]]
        for s in range(0, len(asked), width):
            part = asked[s : s + width]
            table = np.zeros((int(column.max()) + 1, len(part)), np.int32)
            place = np.full(len(ids), -1)
            place[part] = np.arange(len(part))
            mine = place[row] >= 0
            table[column[mine], place[row[mine]]] = 1
            both = np.add.reduceat(table[column], begins, axis=0)  # overlaps of all rows with these
            union = n[rows][:, None] + n[part][None, :] - both
            i, j = np.nonzero((both * den >= union * num) & (ids[rows][:, None] != ids[part][None, :]))
            a.append(ids[rows[i]])
            b.append(ids[part[j]])
        return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x[0] for x in held])
        asked = np.concatenate([x[3] for x in held])
        if len(ids) < 2 or not asked.any():
            return
        sets = np.concatenate([x[1] for x in held])
        a, b = links(ids, sets, np.r_[0, np.cumsum(np.concatenate([x[2] for x in held]))], asked)
        a, b = contract(a, b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                sets, offs = shingle_sets(*word_hashes(batch.column("text")), k)
                ids, pivot, block = (batch.column(c).to_numpy() for c in ("doc_id", "pivot", "block"))
                asked = batch.column("asked").to_numpy(zero_copy_only=False)
                start = np.flatnonzero(np.r_[True, (pivot[1:] != pivot[:-1]) | (block[1:] != block[:-1])])
                for s, e in zip(start, np.r_[start[1:], len(ids)], strict=True):
                    if at != (pivot[s], block[s]):
                        if held:
                            yield from settle(held)
                        held, at = [], (pivot[s], block[s])
                    held.append((ids[s:e], sets[offs[s] : offs[e]], np.diff(offs[s : e + 1]), asked[s:e]))
        if held:
            yield from settle(held)

    return run


def _crossing(num: int, den: int):
    """All pairs of a column's rows that are in different components and groups and have sizes that allow it; of a column's two sides only pairs between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "h"):
            h, doc, n, comp, pivot = (t.column(c).to_numpy() for c in ("h", "doc", "n", "component", "pivot"))
            role, side, apart = (t.column(c).to_numpy() for c in ("first", "side", "apart"))
            n = n.astype(np.int64)
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            ends = np.r_[first[1:], len(h)]
            out: list[tuple] = []
            held = 0
            for s, e in zip(first, ends, strict=True):
                if e - s < 2 or (comp[s:e] == comp[s]).all() or (pivot[s:e] == pivot[s]).all():
                    continue
                for i in s + np.flatnonzero(role[s : e - 1]):  # rows come by size: i is the smaller one
                    top = s + int(np.searchsorted(n[s:e], n[i] * den // num, "right"))
                    j = slice(i + 1, top)
                    j = i + 1 + np.flatnonzero((comp[j] != comp[i]) & (pivot[j] != pivot[i]) & (~apart[j] | (side[j] != side[i])))
                    if len(j):
                        out.append((np.full(len(j), doc[i]), doc[j], np.full(len(j), n[i]), n[j]))
                        held += len(j)
                if held > 500_000:
                    yield _pair_rows(*(np.concatenate([o[x] for o in out]) for x in range(4)))
                    out, held = [], 0
            if out:
                yield _pair_rows(*(np.concatenate([o[x] for o in out]) for x in range(4)))

    return run


def _bounded(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Accumulated counts per pair, without the pairs under their size-derived bound."""
    total = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("shared").cast("long").alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, shared = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb", "shared"))
            keep = shared >= np.minimum(least_shared(na, num, den), least_shared(nb, num, den))
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return total.transform(in_arrow, run, "a long, b long")


def _compare(k: int, num: int, den: int):
    """Pairs of texts that are similar: 100 x intersection >= 75 x union, on their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "ta", 1 << 20):
                sa, oa = shingle_sets(*word_hashes(batch.column("ta")), k)
                sb, ob = shingle_sets(*word_hashes(batch.column("tb")), k)
                rows = np.arange(batch.num_rows)
                # one entry for each row and shingle of both sides: those that occur twice are shared
                row = np.concatenate([np.repeat(rows, np.diff(oa)), np.repeat(rows, np.diff(ob))])
                h = np.concatenate([sa, sb])
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
                both = np.bincount(row[1:][twice], minlength=len(rows))
                union = np.diff(oa) + np.diff(ob) - both
                keep = (both > 0) & (both * den >= union * num)
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def jaccard_components(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (75, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text), by shingles of k lower-cased words.

    Two documents link when their shingle sets have a similarity of at least num / den.
    component_id is the smallest doc_id reached by links. A null, empty or wordless text has no shingles, links
    with nothing and is its own component. A row without doc_id gets its n_shingles, a null component_id, and
    takes no part. Rows of one doc_id are one node. Other columns are ignored; an empty table gives no rows.
    """
    num, den = similarity
    spark, p = docs.sparkSession, n_parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = cut(rows.transform(in_arrow, _sizes(k), "doc_id long, n long, s1 long, s2 long"))
    classes = cut(sizes.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")).filter("rep is not null"))
    entries = rows.transform(in_arrow, _entries(k, 4 * p), "block long, blob binary").repartition(p, "block")
    shared = entries.transform(in_arrow, _counts(4 * p), "block long, blob binary").repartition(p, "block")
    columns = cut(shared.transform(in_arrow, _rarest(num, den), "h long, doc long, n int, first boolean").join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi"))
    # only texts of rows that some column joins with another are fetched, once
    joined = columns.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    columns = cut(columns.join(joined, "h", "left_semi").select("h", "doc", "n", "first"))
    texts = cut(rows.join(columns.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    # a column's pivot is its smallest id; where one column has very many rows the join is skewed, and adaptive execution splits it
    pivots = columns.groupBy("h").agg(F.min("doc").alias("pivot"))
    met = columns.join(pivots, "h").groupBy("doc", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    best = met.groupBy("doc").agg(F.min_by("pivot", F.struct(-F.col("shared"), F.col("pivot"))).alias("pivot"))
    sizes_of = columns.groupBy("doc").agg(F.max("n").alias("n"))
    best = cut(best.join(sizes_of, "doc"))
    many = best.groupBy("pivot").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_ENTRIES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"))
    members = best.select("doc", "pivot").unionAll(best.select(F.col("pivot").alias("doc"), "pivot").distinct()).distinct().join(many, "pivot")

    def product(dealt: DataFrame) -> DataFrame:
        with_text = dealt.join(texts, F.col("doc") == F.col("doc_id")).select("doc_id", "pivot", "block", "asked", "text")
        return with_text.repartition(p, "pivot", "block").sortWithinPartitions("pivot", "block").transform(in_arrow, _products(k, num, den), "a long, b long")

    def deal(some: DataFrame, seed: int) -> DataFrame:
        return some.select("doc", "pivot", F.pmod(F.xxhash64(F.lit(seed), "doc"), F.col("blocks")).alias("block"))

    large = members.filter("blocks > 1")
    everyone = F.lit(True).alias("asked")
    links = cut(product(deal(members, 1).select("*", everyone)).unionAll(product(deal(large, 2).select("*", everyone))))
    found = cut(components(links)).withColumnRenamed("node", "doc")
    labelled = large.join(found, "doc", "left").select("doc", "pivot", "blocks", F.coalesce("component", "doc").alias("component"))
    most = labelled.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("pivot").agg(F.max_by("component", F.struct("c", "component")).alias("most"))
    outside = labelled.join(most, "pivot").filter("component <> most").select("doc", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), everyone)
    links = cut(links.unionAll(product(deal(large, 1).select("*", F.lit(False).alias("asked")).unionAll(outside))))
    found = components(links).withColumnRenamed("node", "doc")
    labelled = best.join(found, "doc", "left").select("doc", "pivot", F.coalesce("component", "doc").alias("component"))
    marked = columns.join(labelled, "doc")
    mixed = marked.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("pivot").alias("lo1"), F.max("pivot").alias("hi1"), F.ceil(F.count(F.lit(1)) / COLUMN_ROWS).cast("int").alias("sides"))
    mixed = mixed.filter("lo < hi and lo1 < hi1").select("h", "sides")
    marked = marked.join(mixed, "h").withColumn("side", F.pmod(F.xxhash64(F.lit(3), "doc"), F.col("sides")).cast("int"))
    marked = marked.select("*", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    # a column's two sides are a column of their own; clashing ones add candidates only
    two = F.when(F.col("sides") > 1, F.xxhash64("h", F.least("side", "other"), F.greatest("side", "other"))).otherwise(F.col("h"))
    apart = (F.col("side") != F.col("other")).alias("apart")
    marked = marked.select(two.alias("h"), "doc", "n", "first", "component", "pivot", "side", apart).repartition(p, "h").sortWithinPartitions("h", "n", "doc")
    rest = _bounded(marked.transform(in_arrow, _crossing(num, den), "a long, b long, na int, nb int, shared long"), num, den)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    more = cut(rest.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").transform(in_arrow, _compare(k, num, den), "a long, b long").distinct())
    labels = components(links.unionAll(more))
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = sizes.join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
