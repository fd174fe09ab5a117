"""Vectorised text primitives over Arrow string columns (numpy, used inside
tasks).  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which
equals ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once by the numpy code (a longer single text is
#: still handled whole, as one slice of its own).
SLICE_BYTES = 1 << 18
#: Texts handled at once, however short.
SLICE_ROWS = 512


def _stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
#: ASCII bytes other than digits and letters: what lies between terms.
NOT_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _stream(256, 11)
_BYTE_LOWER = _BYTE[_LOWER]
_POS_N = 4096
_POS = _stream(_POS_N, 23) | U64(1)
_STEP = _stream(64, 37) | U64(1)


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=col.offset + n + 1)[col.offset:]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def text_slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most SLICE_ROWS rows and ``limit`` bytes of text
    (one row at least)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, i + SLICE_ROWS, max(j, i + 1))
        yield i, j
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, between: np.ndarray = _IS_WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc_offsets) of all words, the maximal runs of bytes that are
    not ``between``; words of text d are ``[doc_offsets[d], doc_offsets[d + 1])``."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ws = between[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ws[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ws[1:]
    start = np.flatnonzero(~ws & (before | cut[:n]))
    end = np.flatnonzero(~ws & (after | cut[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of every word's bytes (A-Z lower-cased when ``lower``), some
    ``SLICE_BYTES`` of words at a time: a very long text takes no more memory."""
    upto = np.cumsum(end - start)
    out, i = np.empty(len(start), U64), 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE_BYTES, side="right")))
        out[i:j] = _hash_words(data, start[i:j], end[i:j] - start[i:j], _BYTE_LOWER if lower else _BYTE)
        i = j
    return out


def _hash_words(data: np.ndarray, start: np.ndarray, lens: np.ndarray, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = int(lens.sum())
        pos = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
        v = code[data[np.repeat(start, lens) + pos]]
        v *= _POS[pos & (_POS_N - 1)]
        if int(lens.max()) > _POS_N:
            v *= (pos // _POS_N).astype(U64) * U64(2) + U64(1)
        h = np.add.reduceat(v, np.cumsum(lens) - lens)
        return mix(h + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(wh: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (ignoring text ends)."""
    n = len(wh) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = np.full(n, U64(k), dtype=U64)
        for j in range(k):
            h += wh[j:j + n] * _STEP[j]
        return mix(h)


def shingle_sets(wh: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc index, shingle hash), distinct, sorted by both.  A text with fewer
    than k words (but one at least) has its whole word sequence as its one
    shingle; a text without words has none."""
    counts = np.diff(woff)
    nsh = np.maximum(counts - k + 1, 0)
    full = window_hashes(wh, k)
    doc = np.repeat(np.arange(len(counts)), nsh)
    first = np.repeat(woff[:-1], nsh) + (np.arange(int(nsh.sum())) - np.repeat(np.cumsum(nsh) - nsh, nsh))
    h = full[first] if len(first) else np.zeros(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        hs = np.empty(len(short), U64)
        with np.errstate(over="ignore"):
            for i, d in enumerate(short):
                w = wh[woff[d]:woff[d + 1]]
                hs[i] = mix(np.array([U64(len(w)) + (w * _STEP[:len(w)]).sum()], dtype=U64))[0]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, hs])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each text's entries in a sorted doc-index array."""
    return np.searchsorted(doc, np.arange(n + 1))


def list_array(values: pa.Array, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)
