"""Vectorised byte kernels on Arrow text columns: words, shingles, rolling hashes.

Every kernel works on the concatenated UTF-8 bytes of a chunk of whole documents, never on prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)
#: Bytes of text that are worked on at once; one longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bytes of spans that are hashed at once.
SPAN_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_codec, _dense = pa.Codec("zstd", 1), pa.Codec("zstd", 4)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (two xor-multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the longest table asked for so far is kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        full = np.full(max(n, SPAN_BYTES + 1), base, dtype=U64)
        full[0] = 1
        got = _powers[base] = np.cumprod(full)
    return got[:n]


def forget() -> None:
    """Give up the tables of powers; within a task they are kept."""
    _powers.clear()


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes of text each, or one document."""
    if not batch.num_rows:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(lens), 0
    while start < len(lens):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per document the index of its first word (n + 1).

    between marks the bytes that are in no word; unless given, words are `[^\\x20\\x09-\\x0D]+`.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~between[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    edge[0] = edge[n] = True
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~prev | edge[:n]))
    nxt = np.empty(n, bool)
    nxt[-1], nxt[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~nxt | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, wherever it stands; spans come in order of their starts and are hashed SPAN_BYTES (or one span) at a time."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, base + SPAN_BYTES)))
        s, e = starts[i:j] - base, ends[i:j] - base
        n = int(e.max())
        pref = np.zeros(n + 1, U64)
        np.cumsum((buf[base : base + n].astype(U64) + U64(1)) * powers(BASE, n), out=pref[1:])
        h = (pref[e] - pref[s]) * powers(BASE_INV, n + 1)[s]
        out[i:j] = mix(h + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and per document the index of its first word (n + 1)."""
    buf, offs = text_bytes(col)
    if lower:
        buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    return span_hashes(buf, starts, ends), first


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on that has k words after it (documents are not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, k, U64)
    for j in range(k):
        h = h * U64(0xC2B2AE3D27D4EB4F) + words[j : j + n]
    return mix(h)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of every document, concatenated, and their offsets (n + 1).

    A document of fewer words has its whole sequence as its one shingle, one without words has none.
    """
    counts = np.diff(first)
    docs = len(counts)
    take = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    offs = np.zeros(docs + 1, np.int64)
    np.cumsum(take, out=offs[1:])
    out = np.zeros(offs[-1], U64)
    doc = np.repeat(np.arange(docs), take)
    at = np.arange(offs[-1]) - offs[doc] + first[:-1][doc]
    full = counts[doc] >= k
    hk = ngram_hashes(words, k)
    out[full] = hk[at[full]]
    for m in range(1, k):
        few = counts[doc] == m
        if few.any():
            out[few] = ngram_hashes(words, m)[at[few]]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[keep], doc[keep]
    offs[1:] = np.cumsum(np.bincount(doc, minlength=docs))
    return out, offs


def compress(raw) -> bytes:  # noqa: ANN001
    """Bytes (or a buffer) compressed, with their size before them."""
    return np.int64(len(raw)).tobytes() + _dense.compress(raw, asbytes=True)


def decompress(blob: bytes) -> bytes:
    """The bytes of compress()."""
    return _codec.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of integers as one compressed blob: bytes of equal significance lie together."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T for a in arrays]
    head = np.array([n, *(ord(a.dtype.char) for a in arrays)], np.int64).tobytes()
    raw = b"".join(p.tobytes() for p in planes)
    return np.int64(len(raw)).tobytes() + head + _codec.compress(raw, asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    """The columns of pack()."""
    size, *head = np.frombuffer(blob, np.int64, columns + 2).tolist()
    n, raw, out, at = head[0], _codec.decompress(blob[8 * (columns + 2) :], size, asbytes=True), [], 0
    for c in head[1:]:
        dtype = np.dtype(chr(c))
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size
    return out
