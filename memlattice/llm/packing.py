"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n tokens is cut into n // limit pieces of the limit's length, and then into pieces as the binary digits
of the rest say, longest first. Pieces of one length make a bucket, numbered by the binary logarithm; within a bucket all sequences
are alike, so batches are cut from it without padding. write_buckets() lays the pieces out by bucket.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .kernels import LOWER, U64, chunks, span_hashes, text_bytes, word_spans

#: Words whose ids a worker remembers; it starts anew beyond.
REMEMBERED = 2_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,!?;:")] = True


#: The steps before the model of tokenizers that may be asked word by word (they lower-case, and no token holds white space,
#: nor an ASCII letter and the punctuation after it).
WORDWISE = (
    ["NFC", "Replace", "Lowercase"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


def wordwise(path: str) -> bool:
    """Whether the tokenizer's normaliser and pre-tokenizer are those of WORDWISE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = parts[0] if parts else {}
    return before == WORDWISE[0] and split.get("pattern") == {"Regex": WORDWISE[1]} and split.get("behavior") == "Removed" and bool(split.get("invert")) and not any(p.get("add_prefix_space") for p in parts)


class WordEncoder:
    """Token ids of texts: word by word for tokenizers of the kind WORDWISE, whole text by whole text for all others.

    Word by word each different one is encoded once and remembered. Stops at a word's end are words of their own, and A-Z are lower-cased
    first; not where that could change ids: in texts with combining marks (composed before they are lower-cased) or with
    what may be a special token.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.wordwise = Tokenizer.from_file(path), wordwise(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.len = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def _units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = word_spans(buf, offs)
        if not len(starts):
            return starts, ends, first
        last = np.maximum.accumulate(np.where(_STOP[buf], np.int32(-1), np.arange(len(buf), dtype=np.int32)))[ends - 1]
        split = (last < ends - 1) & (last >= starts) & _LETTER[buf[last]]
        s = np.concatenate([starts, last[split] + 1])
        e = np.concatenate([np.where(split, last + 1, ends), ends[split]])
        order = np.argsort(s, kind="stable")
        return s[order], e[order], np.searchsorted(s[order], offs)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and their offsets (n + 1)."""
        if not self.wordwise:
            raw = buf.tobytes()
            texts = [raw[s:e].decode("utf-8") for s, e in zip(offs[:-1], offs[1:], strict=True)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter((i for ids in got for i in ids), np.uint32), np.r_[0, np.cumsum([len(ids) for ids in got], dtype=np.int64)]
        starts, ends, first = self._units(buf, offs)
        if len(buf) and not ((buf == 0xCC) | (buf == 0xCD)).any() and not ((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))).any():
            buf = LOWER[buf]
        words, sample, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, words)
        new = np.ones(len(words), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != words[inside]
        if new.any():
            raw = buf.tobytes()
            texts = [raw[starts[i] : ends[i]].decode("utf-8") for i in sample[new]]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            where = len(self.ids) + np.cumsum(lens) - lens
            self.ids = np.concatenate([self.ids, np.fromiter((i for ids in got for i in ids), np.uint32, int(lens.sum()))])
            place = at[new]  # both sides are sorted
            self.known = np.insert(self.known, place, words[new])
            self.at, self.len = np.insert(self.at, place, where), np.insert(self.len, place, lens)
            at = at + np.cumsum(new) - new
        at = at[inverse] if len(words) else np.zeros(0, np.int64)
        lens = self.len[at]
        total = np.r_[0, np.cumsum(lens)]
        src = np.repeat(self.at[at] - total[:-1], lens) + np.arange(total[-1])
        return self.ids[src], total[first]


def _pieces(path: str, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part in chunks(batch):
                encoder = encoder or WordEncoder(path)
                ids, offs = encoder.encode(*text_bytes(part.column("text")))
                docs = part.num_rows
                ids = np.insert(ids, offs[1:], np.uint32(end_id))
                offs = offs + np.arange(docs + 1)
                n = np.diff(offs)
                whole, bits = n // limit, int(limit).bit_length() - 1
                sizes = np.concatenate([np.full((docs, 1), limit), np.tile(1 << np.arange(bits - 1, -1, -1), (docs, 1))], axis=1)
                many = np.concatenate([whole[:, None], (n[:, None] >> np.arange(bits - 1, -1, -1)) & 1], axis=1)
                length = np.repeat(sizes.ravel(), many.ravel())
                doc = np.repeat(np.arange(docs), many.sum(axis=1))
                begin = np.cumsum(length) - length
                edges = np.r_[begin, len(ids)] * 4
                for s in range(0, len(doc), 20_000):
                    e = slice(s, s + 20_000)
                    cut = edges[s : s + len(doc[e]) + 1]
                    body = pa.Array.from_buffers(pa.binary(), len(doc[e]), [None, pa.py_buffer((cut - cut[0]).astype(np.int32).tobytes()), pa.py_buffer(ids[cut[0] // 4 : cut[-1] // 4].astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc[e])), pa.array((begin - offs[doc])[e]), pa.array(length[e]), body, pa.array(n[doc][e])], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return run


def pack_pow2(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket) for each piece of every row of docs(doc_id, text).

    ids are little-endian unsigned 32-bit numbers, each document's followed by end_id. Every length is a power of two up to limit,
    which must be one; a piece is its sequence, so offset is 0 and nothing is padded. bucket is the logarithm of its length. A null or empty text has
    the end_id alone; doc_id, null or repeated, is passed on, and each row is packed; other columns are ignored; an empty table gives no rows.
    sequence_id is unique; there is no shuffle. Any tokenizer of the tokenizers library will do (see WordEncoder).
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.transform(in_arrow, _pieces(tokenizer, limit, end_id), "doc_id long, start long, length long, ids binary, doc_tokens long")
    bucket = F.log2("length").cast("int").alias("bucket")
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as Parquet, a folder for each bucket: a training job reads one length at a time. Each task writes its own files, nothing is shuffled."""
    pieces.sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(path)
