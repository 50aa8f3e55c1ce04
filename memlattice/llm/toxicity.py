"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: how many and how dense lexicon words are (a fixed list, words and word beginnings learned from
labels), how many stand close to a second person, how many are obfuscated; capitals, exclamation and other punctuation,
digits, length. Each different word is looked at once per worker; the rest are counts of bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic
from .common import cut, in_arrow
from .kernels import U64, chunks, span_hashes, text_bytes, word_spans

#: Labelled rows that are learned from at most: the first by a hash of their ids. The only rows not taken whole.
SAMPLE = 12_000
#: Toxic documents a learned word or beginning must stand in, and how many times its share in toxic ones must exceed the other; letters of a beginning.
SUPPORT, ODDS, BEGINNING = 6, 20.0, 5
#: Insults, chosen for this engine; words learned from labels come beside them.
INSULTS = frozenset("asshole bastard bitch clown creep cretin crap damn degenerate dirtbag disgusting dumb dumbass dummy fool freak garbage gross hate hateful hell idiot idiotic ignorant imbecile jerk kill lame liar loser lowlife lunatic maggot moron moronic nasty pathetic pig psycho rat retard rotten rubbish scum scumbag shameful shit shut sick sleazy slob stink stupid subhuman suck swine terrible toxic trash ugly useless vermin vile weirdo worthless".split())
#: Second persons in English, German, French and Spanish.
YOU = frozenset("you your yours yourself yourselves u ur du dein deine deinen deiner dir dich ihr euch euer sie tu toi ton ta tes te vous votre vos tú usted ustedes ti tus vosotros".split())
_LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_LETTERS = re.compile(r"[^\W\d_]+")
LEX, WORD, BEGIN, PERSON, HIDDEN, CAPS, MIXED = (1 << i for i in range(7))
FEATURES = 23
REMEMBERED = 400_000


def plain(word: str) -> str:
    """The letters of a lower-cased word without what stands around them."""
    found = _LETTERS.findall(word)
    return found[0] if len(found) == 1 else max(found, key=len, default="")


class Features:
    """Dense features of texts; remembers what is known of each word."""

    def __init__(self, words: frozenset[str] = frozenset(), begins: frozenset[str] = frozenset()) -> None:
        self.words, self.begins = words, begins
        self.known, self.flags = np.zeros(0, U64), np.zeros(0, np.uint8)

    def _flag(self, word: str) -> int:
        low = word.lower()
        core = plain(low)
        out = LEX * (core in INSULTS) | WORD * (core in self.words) | BEGIN * (core[:BEGINNING] in self.begins) | PERSON * (core in YOU)
        edge = low.strip(".,;:!?\"'()[]{}")
        if edge and not edge.isalpha():
            clear = edge.translate(_LOOKS)
            out |= MIXED * (any(c.isalpha() for c in edge)) | HIDDEN * (clear != core and (clear in INSULTS or clear in self.words))
        return out | CAPS * (len(core) > 1 and word.isupper())

    def _flags(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        words, sample, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known, self.flags = np.zeros(0, U64), np.zeros(0, np.uint8)
        at = np.searchsorted(self.known, words)
        new = np.ones(len(words), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != words[inside]
        if new.any():
            raw = buf.tobytes()
            got = np.array([self._flag(raw[starts[i] : ends[i]].decode("utf-8")) for i in sample[new]], np.uint8)
            known = np.concatenate([self.known, words[new]])
            order = np.argsort(known)
            self.known, self.flags = known[order], np.concatenate([self.flags, got])[order]
            at = np.searchsorted(self.known, words)
        return self.flags[at][inverse] if len(words) else np.zeros(0, np.uint8)

    def of(self, column: pa.Array) -> np.ndarray:
        buf, offs = text_bytes(column)
        docs = len(offs) - 1
        starts, ends, first = word_spans(buf, offs)
        flags = self._flags(buf, starts, ends)
        n = np.diff(first).astype(float)
        doc = np.repeat(np.arange(docs), np.diff(first))
        count = lambda m: np.bincount(doc[m], minlength=docs).astype(float)
        many = {f: count((flags & f) > 0) for f in (LEX, WORD, BEGIN, PERSON, HIDDEN, CAPS, MIXED)}
        hit = (flags & (LEX | WORD | BEGIN | HIDDEN)) > 0
        near = np.zeros(len(flags), bool)
        person = (flags & PERSON) > 0
        for k in range(1, 5):
            near[k:] |= person[:-k] & (doc[k:] == doc[:-k])
            near[:-k] |= person[k:] & (doc[k:] == doc[:-k])
        close, hits = count(hit & near), count(hit)
        size = np.diff(offs).astype(float)

        def bytes_in(table: np.ndarray) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(table[buf])][offs]).astype(float)

        upper, shout, other, digit = (bytes_in(_TABLES[k]) for k in range(4))
        share = lambda v, of: v / (of + 20)
        cols = [np.log1p(n), np.log1p(size)]
        cols += [v for f in (LEX, WORD, BEGIN, PERSON, HIDDEN) for v in (np.log1p(many[f]), share(many[f], n))]
        cols += [np.log1p(hits), share(hits, n), np.log1p(close), share(close, n), share(many[CAPS], n), share(many[MIXED], n)]
        cols += [share(upper, size), share(shout, size), share(other, size), share(digit, size), np.where(n > 0, size / np.maximum(n, 1), 0)]
        return np.stack(cols, axis=1)


_TABLES = np.zeros((4, 256), np.int64)
_TABLES[0, ord("A") : ord("Z") + 1] = 1
_TABLES[1, [ord("!"), ord("?")]] = 1
_TABLES[2, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "!?.,"]] = 1
_TABLES[3, ord("0") : ord("9") + 1] = 1


def _fold(id_col: str, parts: int = 5):  # noqa: ANN202
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text), from labels(doc_id, toxic 0 or 1).

    Labels are learned from at most `sample` rows whose crc32(doc_id as text) mod 5 isn't 0: those of remainder 4 calibrate,
    the others are learned from. held_out marks remainder 0; a null doc_id is not held out. A null text is empty, and empty texts are scored too. Labels
    with a null don't count. Repeated rows count each, both of docs and of labels, so a document labelled 0, 0, 0, 1 is learned from four
    times, once as toxic; where ids repeat so often that more than `sample` labelled texts come together, trees and calibration
    see `sample` of them, by a hash. Without labels of both kinds every score is 0.5 at most
    and follows the lexicon's share of words. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    chosen = chosen.withColumn("fold", _fold("id")).filter("fold <> 0").orderBy(F.xxhash64("id"), "id", "toxic").limit(sample).collect()
    bounded = spark.createDataFrame([(r["id"], r["toxic"], r["fold"]) for r in chosen], "id long, toxic int, fold int")
    # at most `sample` rows of three numbers are broadcast; their texts are read from the corpus once
    known = cut(rows.join(F.broadcast(bounded), F.col("doc_id") == F.col("id")).select("toxic", "fold", "text"))
    learning = known.filter("fold <> 4").agg(F.sum("toxic"), F.count(F.lit(1))).first()
    words, begins = _learned(known.filter("fold <> 4"), learning[0] or 0, learning[1])
    table = known.transform(in_arrow, _featured(words, begins), "toxic int, fold int, x array<double>")
    if known.count() > sample:
        table = table.orderBy(F.xxhash64("toxic", "fold", "x"), F.monotonically_increasing_id()).limit(sample)
    table = table.toPandas()
    model = None
    if len(table):
        x, y, fold = np.stack(table["x"].to_numpy()), table["toxic"].to_numpy(float), table["fold"].to_numpy()
        fit, cal = fold != 4, fold == 4
        if 0 < y[fit].sum() < fit.sum():
            trees = BoostedTrees().fit(x[fit], y[fit])
            cal = cal if 0 < y[cal].sum() < cal.sum() else fit
            model = (trees, Isotonic().fit(trees.margin(x[cal]), y[cal]))
    scored = rows.transform(in_arrow, _scored(words, begins, model), "doc_id long, score double")
    out = scored.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _learned(known: DataFrame, toxic: int, both: int) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word beginnings that mark toxic texts; counted in documents."""
    if not toxic or toxic == both:
        return frozenset(), frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int], list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {w for w in _LETTERS.findall((text or "").lower())}
                for key in [(w, 0) for w in own] + [(b, 1) for b in {w[:BEGINNING] for w in own if len(w) > BEGINNING}]:
                    counts.setdefault(key, [0, 0])[y] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], names=["w", "kind", "c0", "c1"])

    total = known.select("text", "toxic").transform(in_arrow, run, "w string, kind int, c0 long, c1 long").groupBy("w", "kind").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    odds = (F.col("c1") / toxic) / ((F.col("c0") + 0.5) / (both - toxic))
    # a learned word stands in SUPPORT toxic texts of the sample, so the sample bounds their number
    found = total.filter((F.col("c1") >= SUPPORT) & (odds >= ODDS)).collect()
    return frozenset(r["w"] for r in found if r["kind"] == 0), frozenset(r["w"] for r in found if r["kind"] == 1)


def _featured(words: frozenset[str], begins: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(words, begins)
        for batch in batches:
            for part in chunks(batch):
                x = features.of(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("fold").cast(pa.int32()), lists], names=["toxic", "fold", "x"])

    return run


def _scored(words: frozenset[str], begins: frozenset[str], model: tuple[BoostedTrees, Isotonic] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(words, begins)
        for batch in batches:
            for part in chunks(batch):
                x = features.of(part.column("text"))
                score = model[1].predict(model[0].margin(x)) if model else np.minimum(0.5, x[:, 3])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(score, 0, 1))], names=["doc_id", "score"])

    return run
