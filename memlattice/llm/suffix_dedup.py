"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through `depth` bytes; those that are equal so far begin the repeated windows.
A full suffix table would be many times the text, so the sort runs on a sparse set of suffixes that equal windows
agree on: in each window of `depth` bytes, the one whose first `gram` bytes hash lowest (the leftmost if tied). A
sampled suffix stands for the run of windows that chose it, [lo, hi]. Digits from the most significant on:

1. first digit, the suffix's first `gram` bytes; second digit, all bytes of its run, lo to hi + depth. Rows with
   equal digits have equal windows throughout: all but the first are removed whole. A suffix alone in its first digit
   is done: none of its windows repeats.
2. Suffixes that share the first digit but not the second are split: window by window, the last digit is
   the window itself. Equal groups are exactly the repeated windows, and all but the first of a group are removed.
   A first digit with many different runs is dealt by window instead, so that it doesn't meet in one task.

Equal rows that a worker holds are folded before each shuffle, so a copied passage costs one row for each lot held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, keyed, n_parts
from .kernels import BASE, BASE_INV, U64, chunks, mix, powers, text_bytes

#: A first digit with more different runs than this is dealt by window.
WIDE = 64
#: Sampled suffixes that a worker gathers before it folds and sends them.
HELD_ROWS = 1_000_000
#: Row kinds: bytes to remove; a run of windows; a run whose windows go by first digit, by window; a window.
REMOVE, RUN, SPLIT, SPREAD, WINDOW = 0, 1, 2, 3, 4
#: Positions carry the rank of rows that share a doc_id above this bit.
RANK = 40
_LOW = (1 << RANK) - 1


def _prefix(buf: np.ndarray) -> np.ndarray:
    pref = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(BASE, len(buf)), out=pref[1:])
    return pref


def _hash(pref: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the bytes s to e, without its last mixing."""
    return (pref[e] - pref[s]) * powers(BASE_INV, len(pref))[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)


def _second(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of an independent hash: bytes through a random table, another base."""
    table = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
    pref = np.zeros(len(buf) + 1, U64)
    np.cumsum(table[buf] * powers(0xDA942042E4DD58B5, len(buf)), out=pref[1:])
    return pref


def _hash2(pref: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((pref[e] - pref[s]) * powers(pow(0xDA942042E4DD58B5, -1, 2**64), len(pref))[s] + (e - s).astype(U64))


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def sample(buf: np.ndarray, offs: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, sampled position, lo, hi) for each run of windows that chose the position; positions in buf."""
    n, w = len(buf), depth - gram + 1
    lens = np.diff(offs)
    if n < depth or not (lens >= depth).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z
    at = np.arange(n - gram + 1)
    h = mix(_hash(_prefix(buf), at, at + gram))
    if n >> 32:
        raise ValueError("a chunk of text must be under 4 GB")
    bits = U64(32)  # ties in the hash's upper half go to the leftmost, alike in chunks of any size
    low = _slide_min((h >> bits << bits) | at.astype(U64), w)
    pick = (low & ((U64(1) << bits) - U64(1))).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)  # a window may start where its document has depth bytes left
    long = lens >= depth
    np.add.at(edge, offs[:-1][long], 1)
    np.add.at(edge, offs[1:][long] - depth + 1, -1)
    valid = np.cumsum(edge[: len(pick)]) > 0
    differs = pick[1:] != pick[:-1]
    # the next document's first window can follow this one's last only where depth is 1
    begins, stops = valid.copy(), valid.copy()
    begins[1:] &= differs | ~valid[:-1]
    stops[:-1] &= differs | ~valid[1:]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(stops)
    return np.searchsorted(offs, lo, "right") - 1, pick[lo], lo, hi


SCHEMA = "kind int, key long, k2 long, doc long, pos long, span int, data binary"


def _rows(kind, key, k2, doc, pos, span, data=None) -> pa.RecordBatch:  # noqa: ANN001
    n = len(doc)
    kind = np.full(n, kind, np.int32) if np.isscalar(kind) else kind
    cols = [pa.array(kind), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, k2)), pa.array(doc), pa.array(pos), pa.array(span.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.binary()) if data is None else data], names=["kind", "key", "k2", "doc", "pos", "span", "data"])


def _removed(doc: np.ndarray, pos: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Rows to remove, with overlaps joined; they are dealt evenly."""
    order = np.lexsort((pos, doc))
    doc, pos, end = doc[order], pos[order], (pos + length)[order]
    if len(doc):
        # running maximum of the ends within a document, as offsets that grow from one document to the next
        group = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
        rank = np.argsort(np.argsort(end, kind="stable"), kind="stable")
        by_rank = np.sort(end, kind="stable")
        top = by_rank[np.maximum.accumulate(rank + group * len(doc)) - group * len(doc)]
        new = np.r_[True, (group[1:] != group[:-1]) | (pos[1:] > top[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(doc)] - 1
        doc, pos, end = doc[first], pos[first], top[last]
    return _rows(REMOVE, mix(doc.astype(U64) * U64(3) + pos.astype(U64)), np.zeros(len(doc), np.int64), doc, pos, end - pos)


def _fold_first(key: np.ndarray, k2: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first and of the other rows of each (key, k2), first by (doc, pos)."""
    order = np.lexsort((pos, doc, k2, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    return order[new], order[~new]


def _digits(depth: int, gram: int):
    """First and second digit of the sampled suffixes; equal ones among those held are folded here."""

    def folded(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        k1, k2, ids, pos, span = (np.concatenate([g[i] for g in got]) for i in range(5))
        first, rest = _fold_first(k1, k2, ids, pos)
        yield _rows(RUN, k1[first], k2[first], ids[first], pos[first], span[first])
        if len(rest):
            yield _removed(ids[rest], pos[rest], span[rest] + depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            for part in chunks(batch):
                buf, offs = text_bytes(part.column("text"))
                d, a, lo, hi = sample(buf, offs, depth, gram)
                if not len(d):
                    continue
                pref = _prefix(buf)
                k1 = mix(_hash(pref, a, a + gram))
                k2 = _hash2(_second(buf), lo, hi + depth)
                ids = part.column("_d").to_numpy()[d]
                pos = (part.column("_r").to_numpy()[d].astype(np.int64) << RANK) + lo - offs[d]
                got.append((k1, k2, ids, pos, hi - lo))
                held += len(d)
                if held >= HELD_ROWS:
                    yield from folded(got)
                    got, held = [], 0
        if got:
            yield from folded(got)

    return run


def _first_digits(depth: int):
    """Groups of the first digit, their rows in order of the second; memory doesn't grow with a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # first rows of the runs of the last digit; of a wide one its last run only
        wide = False
        names = ("key", "k2", "doc", "pos", "span")
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == REMOVE).any():
                yield batch.filter(pa.array(kind == REMOVE))
            cols = [batch.column(c).to_numpy()[kind == RUN] for c in names]
            old = 0
            if held is not None:
                old = len(held[0])
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            key, k2, doc, pos, span = cols
            if not len(key):
                continue
            new_key = np.r_[True, key[1:] != key[:-1]]
            new_run = new_key | np.r_[True, k2[1:] != k2[:-1]]
            rest = ~new_run
            if rest.any():
                yield _removed(doc[rest], pos[rest], span[rest].astype(np.int64) + depth)
            cols = [c[new_run] for c in cols]
            key = cols[0]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[start, len(key)])
            kind = np.where(count > WIDE, SPREAD, np.where(count > 1, SPLIT, REMOVE))
            if wide:
                kind[0] = SPREAD
            last_wide = bool(kind[-1] == SPREAD)
            kind = np.repeat(kind, count)
            send = kind != REMOVE
            if wide:
                send[:old] = False  # sent before
            if not last_wide:
                send[start[-1] :] = False  # more of this digit may follow
            if send.any():
                yield _rows(kind[send].astype(np.int32), *(c[send] for c in cols))
            held = [c[-1:] if last_wide else c[start[-1] :] for c in cols]
            wide = last_wide
        if held is not None and not wide and len(held[0]) > 1:
            yield _rows(SPLIT, *held)

    return run


def _flat(col: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Row number and fields of the elements of a list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = np.zeros(len(col), np.int64) if col.null_count == len(col) else np.asarray(col.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(col)), lens), col.flatten()


def _windows(depth: int):
    """Fetches the bytes of the runs that are still open: a SPLIT run's text, or a SPREAD run's windows one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spread = []
            for part in chunks(batch):
                buf, offs = text_bytes(part.column("text"))
                row, items = _flat(part.column("items"))
                kind, key, pos, span = (items.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "pos", "span"))
                ids = part.column("_d").to_numpy()[row]
                span = span.astype(np.int64)
                at = offs[row] + (pos & _LOW)
                m = kind == REMOVE
                if m.any():
                    yield _removed(ids[m], pos[m], span[m])
                m = kind == SPLIT
                if m.any():
                    length = span[m] + depth
                    ends = np.cumsum(length)
                    src = np.repeat(at[m] - (ends - length), length) + np.arange(ends[-1])
                    data = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(buf[src].tobytes())])
                    yield _rows(SPLIT, key[m], np.zeros(int(m.sum()), np.int64), ids[m], pos[m], span[m], data)
                m = kind == SPREAD
                if m.any():
                    n = span[m] + 1
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    s = np.repeat(at[m], n) + step
                    spread.append((mix(_hash(_prefix(buf), s, s + depth)), _hash2(_second(buf), s, s + depth), np.repeat(ids[m], n), np.repeat(pos[m], n) + step))
            if spread:
                key, k2, ids, pos = (np.concatenate([g[i] for g in spread]) for i in range(4))
                first, rest = _fold_first(key, k2, ids, pos)
                yield _rows(WINDOW, key[first], k2[first], ids[first], pos[first], np.zeros(len(first), np.int64))
                if len(rest):
                    yield _removed(ids[rest], pos[rest], np.full(len(rest), depth))

    return run


def _last_digit(depth: int, limit: int):
    """Windows in groups of equal ones: all but the first of each group are removed."""

    def settle(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held).combine_chunks()
        kind, key, k2, doc, pos, span = (t.column(c).to_numpy() for c in ("kind", "key", "k2", "doc", "pos", "span"))
        m = kind == WINDOW
        parts = [(key[m].view(U64), k2[m].view(U64), doc[m], pos[m])]
        m = kind == SPLIT
        if m.any():
            buf, offs = text_bytes(t.column("data").filter(pa.array(m)))
            n = span[m].astype(np.int64) + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s = np.repeat(offs[:-1], n) + step
            parts.append((np.repeat(key[m].view(U64), n), _hash2(_second(buf), s, s + depth), np.repeat(doc[m], n), np.repeat(pos[m], n) + step))
        key, k2, doc, pos = (np.concatenate([p[i] for p in parts]) for i in range(4))
        _, rest = _fold_first(key, k2, doc, pos)
        if len(rest):
            yield _removed(doc[rest], pos[rest], np.full(len(rest), depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        weight = 0
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == REMOVE).any():
                yield batch.filter(pa.array(kind == REMOVE))
                batch = batch.filter(pa.array(kind != REMOVE))
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            weight += int(batch.column("span").to_numpy().sum()) + batch.num_rows
            if weight >= limit:
                t = pa.concat_tables(held)
                key = t.column("key").to_numpy()
                at = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if at:
                    yield from settle([t.slice(0, at)])
                held = [t.slice(at)]
                weight = int(held[0].column("span").to_numpy().sum()) + held[0].num_rows
        if held:
            yield from settle(held)

    return run


def _apply(as_text: bool, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                buf, offs = text_bytes(part.column("text"))
                row, items = _flat(part.column("items"))
                mark = np.zeros(len(buf) + 1, np.int32)
                if len(row):
                    at = offs[row] + (items.field("pos").to_numpy(zero_copy_only=False) & _LOW)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + items.field("span").to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(mark[:-1]) > 0
                edge = np.zeros(len(buf) + 1, bool)
                edge[offs] = True
                prev, nxt = np.r_[False, gone[:-1]][: len(gone)], np.r_[gone[1:], False][: len(gone)]
                starts = np.flatnonzero(gone & (~prev | edge[:-1]))
                ends = np.flatnonzero(gone & (~nxt | edge[1:])) + 1
                count = np.searchsorted(starts, offs)
                doc = np.searchsorted(offs, starts, "right") - 1
                kept_at = np.r_[0, np.cumsum(~gone)][offs]
                kept = buf[~gone]
                spans = pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts - offs[doc]), pa.array(ends - starts)], names=["start", "length"]))
                if as_text:
                    body = pa.array([kept[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)], pa.string())
                else:
                    body = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(kept_at.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(np.diff(offs)), body, spans], names=[*carried, "n_bytes", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, depth: int = 100, gram: int = 32, as_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, n_bytes, kept, spans) of every row of docs(doc_id, text) without its repeated windows.

    A byte goes if a window of `depth` bytes covers it that also starts earlier: in a row of smaller doc_id, or
    earlier in the same row. Overlaps count; windows never cross rows and are judged on the input. kept is binary, or
    with as_text a string without characters that a removal cut apart. spans lists the maximal removed runs.
    A null text is empty; texts under depth bytes lose nothing; a null doc_id comes before all others; rows of one
    doc_id follow each other in order of their text (equal ones in any order, with equal results in total). Columns named in carry are passed on (names of
    returned columns are refused), others ignored. An empty table gives no rows.
    """
    if not 0 < gram <= depth:
        raise ValueError("gram must be between 1 and depth")
    spark, p = docs.sparkSession, n_parts(docs.sparkSession)
    rows = keyed(docs, carry=carry)
    if {"doc_id", "n_bytes", "kept", "spans"} & set(carry) or len(set(carry)) < len(carry):
        raise ValueError("carry names a column twice or one of those returned")
    carried = [f"_c{i}" for i in range(len(carry))]
    # both joins take the same columns, so the texts are shuffled once and that exchange is used again
    texts = rows.select("_d", "_r", "text", "doc_id", *carried)
    by_digit = texts.transform(in_arrow, _digits(depth, gram), SCHEMA).repartition(p, "key").sortWithinPartitions("key", "k2", "doc", "pos")
    open_runs = by_digit.transform(in_arrow, _first_digits(depth), SCHEMA).select(F.col("doc").alias("_d"), F.shiftright("pos", RANK).cast("int").alias("_r"), "kind", "key", "pos", "span")
    items = open_runs.groupBy("_d", "_r").agg(F.collect_list(F.struct("kind", "key", "pos", "span")).alias("items"))
    windows = texts.join(items, ["_d", "_r"]).transform(in_arrow, _windows(depth), SCHEMA)
    by_window = windows.repartition(p, "key").sortWithinPartitions("key")
    gone = by_window.transform(in_arrow, _last_digit(depth, 2_000_000), SCHEMA).select(F.col("doc").alias("_d"), F.shiftright("pos", RANK).cast("int").alias("_r"), "pos", "span")
    items = gone.groupBy("_d", "_r").agg(F.collect_list(F.struct("pos", "span")).alias("items"))
    kept = T.StringType() if as_text else T.BinaryType()
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([*rows.select("doc_id", *carried).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("kept", kept), T.StructField("spans", spans)])
    out = texts.join(items, ["_d", "_r"], "left").transform(in_arrow, _apply(as_text, ["doc_id", *carried]), schema)
    return out.withColumnsRenamed(dict(zip(carried, carry, strict=True)))
