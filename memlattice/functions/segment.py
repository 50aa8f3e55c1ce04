"""Words of Chinese runs by a dictionary: a graph of all its words in a run, and the best path through it."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from ..staging import cut
from .text import fold

_CHINESE = "[㐀-䶿一-鿿]"
#: Weights are whole millionths of a logarithm, so that sums are exact and equal paths are equal.
SCALE = 1_000_000
#: Letters of a piece of a dictionary, which a task holds as a trie; and of the texts that it looks up at a time (or one row's).
LETTERS, CHUNK = 1 << 24, 1 << 19
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)


def is_chinese(c: Column) -> Column:
    return c.rlike(f"^{_CHINESE}+$")


def pieces(c: Column) -> Column:
    """Runs of letters and digits of any script, folded; Chinese characters make runs of their own."""
    apart = F.when(c.rlike(_CHINESE), F.regexp_replace(fold(c), f"({_CHINESE}+)", " $1 ")).otherwise(fold(c))
    return F.filter(F.split(apart, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def symbols(c: Column) -> Column:
    """Code symbols as they stand, folded: pieces of letters and digits with _ . / or - between them."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+(?:[_./-]+[\p{L}\p{N}]+)+)"), 1)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the texts one after the other, and where each text ends."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)


class Trie:
    """Words with weights; a node is a number, 0 the root, and is found by its parent and character in a table with open addresses."""

    NONE = np.int32(1)  # weights are 0 or less

    def __init__(self, packed: tuple[bytes, bytes, bytes]) -> None:
        of = lambda i, kind: np.frombuffer(zlib.decompress(packed[i]), kind)
        self.keys = np.cumsum(of(0, "<i8"))
        self.weights = np.full(len(self.keys), self.NONE)
        self.weights[np.cumsum(of(1, "<i8"))] = of(2, "<i4")
        self.bits = max(4, (2 * len(self.keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(1, len(self.keys))
        slot = self._slot(self.keys[1:])
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several the last has it
            more = self.table[slot] != left
            left, slot = left[more], (slot[more] + 1) & (len(self.table) - 1)

    @staticmethod
    def pack(words: list[str], weights: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Different words, as bytes that a trie is made of."""
        codes, ends = codes_of(words)
        lengths = np.diff(ends, prepend=0)
        node, keys, n = np.zeros(len(words), np.int64), [np.array([-1])], 1
        depth, left = 0, np.flatnonzero(lengths > 0)
        while len(left):
            new, place = np.unique(node[left] << 21 | codes[ends[left] - lengths[left] + depth], return_inverse=True)
            node[left] = n + place
            keys.append(new)
            n, depth = n + len(new), depth + 1
            left = left[lengths[left] > depth]
        order = np.argsort(node)
        small = lambda x: zlib.compress(x.tobytes(), 1)
        return small(np.diff(np.concatenate(keys), prepend=0)), small(np.diff(node[order], prepend=0)), small(weights[order].astype("<i4"))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes below by these characters, 0 where there is none."""
        key = node << 21 | code
        slot = self._slot(key)
        out = self.table[slot].astype(np.int64)
        # an empty slot's -1 reads the last key; it is no match
        other = np.flatnonzero(self.keys[out] != key)
        out[out < 0] = 0
        other = other[out[other] > 0]
        key, slot = key[other], slot[other]
        while len(other):
            slot = (slot + 1) & (len(self.table) - 1)
            at = self.table[slot]
            ok = (at < 0) | (self.keys[at] == key)
            out[other[ok]] = np.maximum(at[ok], 0)
            other, slot, key = other[~ok], slot[~ok], key[~ok]
        return out

    def edges(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows start, length, weight, node of all words in the runs that end there."""
        last = np.repeat(ends, np.diff(ends, prepend=0))
        at, node, depth, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        while len(at):
            node = self.step(node, codes[at + depth] if depth else codes)
            there = np.flatnonzero(node)
            at, node, depth = at[there], node[there], depth + 1
            weight = self.weights[node]
            word = np.flatnonzero(weight != self.NONE)
            found.append(np.stack([at[word], np.full(len(word), depth), weight[word], node[word]]))
            inside = np.flatnonzero(at + depth < last[at])
            at, node = at[inside], node[inside]
        return np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)


def best_paths(codes: np.ndarray, edges: np.ndarray, unknown: int) -> np.ndarray:
    """Rows start, length, name of the words on the paths of largest weight; of equal ones those with the longer first word, and so on.

    edges has rows start, length, weight, name; none leads out of its run. A character where no edge starts stands alone with the weight of an unknown one; its
    name is -1 less its code. Places that no edge leads over cut the runs into parts, which are walked side by side from their ends.
    """
    n = len(codes)
    starts = np.bincount(edges[0], minlength=n + 2)
    alone = np.flatnonzero(starts[:n] == 0)
    over = np.cumsum(np.append(0, starts[: n + 1]) - np.bincount(edges[0] + edges[1], minlength=n + 2))
    edges = np.concatenate([edges, np.stack([alone, np.ones_like(alone), np.full_like(alone, unknown), -1 - codes[alone]])], axis=1)
    whole = over[: n + 1] == 0
    places = np.flatnonzero(whole)
    level = np.repeat(places, np.diff(places, prepend=-1))[1:] if n else places[:0]  # the next place at or after a letter's end
    level = level - np.arange(n)
    order = np.argsort(level[edges[0]] * (n + 1) + edges[0])
    start, length, weight = (e[order] for e in edges[:3])
    # a weight and, for equal ones, the length in one number; sums of weights stay multiples of `unit`
    unit = int(length.max(initial=0)) + 1
    kind = np.int64 if (int(level.max(initial=0)) + 1) * (int(np.abs(weight).max(initial=0)) + 1) * unit < 1 << 62 else object
    value, best, step = weight.astype(kind) * unit + length, np.zeros(n + 2, kind), np.zeros(n + 1, np.int64)
    target = start + length
    target[whole[target]] = n + 1
    first = np.flatnonzero(np.diff(start, prepend=-1))
    own = start[first]
    bounds = np.flatnonzero(np.diff(level[own], prepend=-1, append=-1)).tolist()
    first = np.append(first, len(start))
    for i, j in itertools.pairwise(bounds):
        lo, hi = first[i], first[j]
        most, at = np.maximum.reduceat(value[lo:hi] + best[target[lo:hi]], first[i:j] - lo), own[i:j]
        step[at] = longest = most % unit
        best[at] = most - longest
    on, at = np.zeros(n + 1, bool), places[places < n]
    while len(at):
        on[at] = True
        at = at + step[at]
        at = at[~whole[at]]
    taken = np.flatnonzero((step[edges[0]] == edges[1]) & on[edges[0]])
    taken = taken[np.argsort(edges[0, taken])]
    return edges[:, taken][[0, 1, 3]]


class Piece:
    """A piece of a dictionary as it travels; a worker makes its trie once."""

    def __init__(self, number: int, words: list[str], weights: np.ndarray) -> None:
        self.number, self.packed = number, Trie.pack(words, weights)

    def edges(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not hasattr(self, "trie"):
            self.trie = Trie(self.packed)
        out = self.trie.edges(codes, ends)
        out[3] |= self.number << 32
        return out


def lots(sizes: list[int]) -> Iterator[range]:
    """Rows that follow each other, of CHUNK letters at most or one row."""
    first, n = 0, 0
    for i, size in enumerate(sizes):
        if i > first and n + size > CHUNK:
            yield range(first, i)
            first, n = i, 0
        n += size
    if first < len(sizes):
        yield range(first, len(sizes))


def _cut(rows: DataFrame, runs: Callable[[pa.RecordBatch], list[list[str]]], dictionary: DataFrame, give: Callable, schema: StructType) -> DataFrame:
    """What give(batch, rows, texts, owner, path) gives: texts are the runs that runs() finds in these rows, owner the place of each one's row, path the words on the best paths.

    A piece of the dictionary of LETTERS letters or so goes to all tasks. With several pieces rows are written with the words found so far, piece by piece, and cut with the last.
    """
    spark = rows.sparkSession
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    words = dictionary.filter("freq > 0 and word <> ''").groupBy("word").agg(F.sum("freq").cast("double").alias("freq"))
    known = words.agg(F.sum("freq").alias("total"), F.sum(F.length("word")).alias("letters")).first()  # one row
    total, parts = known["total"] or 1.0, -(-(known["letters"] or 0) // LETTERS) or 1
    unknown = math.floor(SCALE * -math.log(total) + 0.5)
    weighted = words.select("word", F.floor(SCALE * F.log(F.col("freq") / total) + 0.5).cast("int").alias("weight"))
    if parts > 1:
        weighted = cut(weighted.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts))))
        rows = rows.withColumn("_edges", F.lit(b""))

    def piece(part: int):  # noqa: ANN202
        some = (weighted.filter(F.col("part") == part) if parts > 1 else weighted).select("word", "weight").toArrow()
        return spark.sparkContext.broadcast(Piece(part, some["word"].to_pylist(), some["weight"].to_numpy()))

    def found(batch: pa.RecordBatch, piece) -> Iterator[tuple]:  # noqa: ANN001
        each = runs(batch)
        for lot in lots([sum(map(len, r)) for r in each]):
            texts, owner = [t for i in lot for t in each[i]], np.array([i for i in lot for _ in each[i]], np.int64)
            codes, ends = codes_of(texts)
            edges = piece.value.edges(codes, ends) if len(codes) else np.zeros((4, 0), np.int64)
            # rows start at their own letter 0 in what was found before
            base = np.cumsum([0, *(sum(map(len, each[i])) for i in lot)])
            yield lot, texts, owner, codes, ends, edges, base

    def add(piece) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = batch.column("_edges").to_pylist()
                for lot, _, _, _, _, edges, base in found(batch, piece):
                    row = np.searchsorted(base, edges[0], "right") - 1
                    edges[0] -= base[row]
                    for k, i in enumerate(lot):
                        held[i] += edges[:, row == k].T.astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, pa.binary())], names=batch.schema.names)

        return run

    def last(piece) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = batch.column("_edges").to_pylist() if parts > 1 else None
                for lot, texts, owner, codes, _, edges, base in found(batch, piece):
                    if held:
                        more = [np.frombuffer(held[i], "<i8").reshape(-1, 4).T + np.array([[base[k]], [0], [0], [0]]) for k, i in enumerate(lot)]
                        edges = np.concatenate([edges, *more], axis=1)
                    yield give(batch, lot, texts, owner, best_paths(codes, edges, unknown))

        return run

    for part in range(parts - 1):
        rows = cut(rows.mapInArrow(add(piece(part)), rows.schema))
    return rows.mapInArrow(last(piece(parts - 1)), schema)


def segment(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run, words array<string>) of each different run of runs(run), cut by dictionary(word, freq).

    A word weighs the logarithm of its share of all freq. Words are looked up in a trie, where they stand; a dictionary may be of any size, as it is taken in
    pieces. A character stands alone if the dictionary has it, or (with a freq of 1) if none of its words begins there. New words
    that the dictionary lacks are not guessed. Words without a positive freq are left out, those given twice have the sum; null and empty runs are dropped.
    """

    def give(batch: pa.RecordBatch, lot: range, texts: list[str], _: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
        joined, ends = "".join(texts), np.cumsum([len(t) for t in texts])
        words = [joined[a : a + n] for a, n in zip(path[0].tolist(), path[1].tolist(), strict=True)]
        offsets = np.concatenate([[0], np.searchsorted(path[0], ends)])
        return pa.RecordBatch.from_arrays([batch.column("run").slice(lot.start, len(lot)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words, pa.string()))], names=["run", "words"])

    runs = runs.select("run").filter("run <> ''").distinct()
    return _cut(runs, lambda batch: [[r] for r in batch.column("run").to_pylist()], dictionary, give, "run string, words array<string>")


def counted_terms(docs: DataFrame, text: Column, by: list[str], dictionary: DataFrame | None = None, with_symbols: bool = False) -> DataFrame:
    """(*by, term, tf, dl) of all terms of the texts; dl is how many a text has. Whole symbols stand beside their pieces and add no length.

    With a dictionary Chinese runs are cut into its words, where they stand: a text's terms are counted in one go and only these leave the task.
    """
    bag = docs.select(*by, text.alias("_text")).withColumn("w", pieces(F.col("_text"))).withColumn("dl", F.size("w"))
    if with_symbols:
        bag = bag.withColumn("w", F.concat("w", symbols(F.col("_text"))))
    if dictionary is None:
        each = bag.select(*by, "dl", F.explode("w").alias("term")).groupBy(*by, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        return each.select(*by, "term", "tf", "dl")
    chinese = re.compile(f"{_CHINESE}+").fullmatch
    schema = StructType(bag.select(*by).schema.fields).add("term", StringType()).add("tf", LongType()).add("dl", IntegerType())

    def give(batch: pa.RecordBatch, lot: range, texts: list[str], owner: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
        joined, ends = "".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        row = owner[np.searchsorted(ends, path[0], "right")] if len(ends) else path[0]
        name, place = np.unique(path[2], return_inverse=True)
        _, first, tf = np.unique((row - lot.start) * max(1, len(name)) + place, return_index=True, return_counts=True)
        terms = [joined[a : a + n] for a, n in zip(path[0][first].tolist(), path[1][first].tolist(), strict=True)]
        at, tf = row[first].tolist(), tf.tolist()
        for i, w in zip(lot, batch.column("w").slice(lot.start, len(lot)).to_pylist(), strict=True):
            others = Counter(t for t in w or () if not chinese(t))
            terms += others.keys()
            tf += others.values()
            at += [i] * len(others)
        dl = batch.column("dl").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + np.bincount(row, minlength=batch.num_rows) - np.bincount(owner, minlength=batch.num_rows)
        at = np.array(at, np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in by), pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(dl[at], pa.int32())], names=[*by, "term", "tf", "dl"])

    out = _cut(bag.select(*by, "dl", "w"), lambda batch: [[t for t in w or () if chinese(t)] for w in batch.column("w").to_pylist()], dictionary, give, schema)
    if docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        out = out.groupBy(*by, "dl", "term").agg(F.sum("tf").alias("tf")).select(*by, "term", "tf", "dl")
    return out


def query_terms(queries: DataFrame, by: list[str], dictionary: DataFrame | None = None, with_symbols: bool = True) -> DataFrame:
    """(*by, term) that a query asks for: its distinct terms without single Chinese characters and the mark `pattern`; a code symbol whole and in pieces."""
    found = counted_terms(queries, F.col("text"), by, dictionary, with_symbols).select(*by, "term").distinct()
    return found.filter((F.col("term") != "pattern") & ~F.col("term").rlike(f"^{_CHINESE}$"))
