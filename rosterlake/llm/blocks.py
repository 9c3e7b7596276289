"""Array forms of texts, shared by the operators: whole Arrow batches become byte buffers, and words, hashes and
minimizers are computed for a buffer at once. Words are maximal runs of bytes other than space and 0x09-0x0D."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(31))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h = h * U(0xA0761D6478BD642F)
    h ^= h >> U(29)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
_POW = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, U)
            p[0] = 1
            _POW[k] = np.cumprod(p)
    return _POW[0][:n], _POW[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * B**i modulo 2**64, from which span() gives the hash of any run in one step."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _powers(len(values))[0], out=out[1:])
    return out


def span(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inv = _powers(len(sums))[1]
    return mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(U) * U(0xC2B2AE3D27D4EB4F))


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def sliding_argmin(hashes: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least hash in each run of w; by the upper 32 bits, which content alone decides."""
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    packed = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U)
    packed[:n] = (hashes & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    rows = packed.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[: n - w + 1], head[w - 1 : n]) & U(0xFFFFFFFF)).astype(np.int64)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), then those of first[1], and so on."""
    count = np.maximum(count, 0)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - count), count)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its values; a null is an empty value."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", target: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with about target bytes of text each, as (rows, bytes, offsets); a longer text is a
    piece of its own."""
    for batch in batches:
        buf, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + target, "right")) - 1)
            j = min(j, n, i + 20_000)
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def pieces(batches: Iterator[pa.RecordBatch], overlap: int, column: str = "text", target: int = 512 << 10) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """slices, with a long text cut into pieces of about target bytes: (rows, bytes, offsets, byte of the text at which they
    begin). Neighbours share overlap bytes, so a window of up to overlap + 1 bytes lies in one piece at least, and
    one that starts in the shared bytes and is longer lies in the later piece only."""
    for rows, buf, off in slices(batches, column, target):
        if len(buf) <= 2 * target:
            yield rows, buf, off, 0
            continue
        for at in range(0, len(buf), target):
            part = buf[at : at + target + overlap]
            yield rows, part, np.array([0, len(part)]), at


def word_pieces(batches: Iterator[pa.RecordBatch], overlap: int, column: str = "text", target: int = 512 << 10) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """As pieces, cut between words: neighbours share overlap words, and the last number is the word of the text at which
    they begin. A window of overlap + 1 words lies in exactly one piece."""
    for rows, buf, off in slices(batches, column, target):
        if len(buf) <= 2 * target:
            yield rows, buf, off, 0
            continue
        at, first = 0, 0
        while at < len(buf):
            stop = at + target
            while stop < len(buf):  # to the next space, and at least overlap + 1 words
                gap = np.flatnonzero(_SPACE[buf[stop : stop + target]])
                stop = stop + int(gap[0]) if len(gap) else min(len(buf), stop + target)
                if len(gap):
                    start, _, _ = words(buf[at:stop], np.array([0, stop - at]))
                    if len(start) > overlap:
                        break
                    stop += target
            part = buf[at:stop]
            yield rows, part, np.array([0, len(part)]), first
            if stop >= len(buf):
                break
            keep = len(start) - overlap
            first += keep
            at += int(start[keep]) if overlap else len(part)


def digests(raw: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH3 of each run of bytes: what equal content is told by, where prefix sums modulo 2**64 are too weak."""
    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(raw[a:b], seed) for a, b in zip(start.tolist(), end.tolist())), U, len(start))


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another, each after one space but the first: the bytes, and where each starts and ends."""
    lens = end - start
    at = np.cumsum(lens + 1) - (lens + 1)
    out = np.full(int(at[-1] + lens[-1]) if len(at) else 0, 32, np.uint8)
    out[ranges(at, lens)] = buf[ranges(start, lens)]
    return out, at, at + lens


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of each text's words among them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[buf]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    start[edges] = solid[edges]
    stop[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def runs_of(label: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of equal label over consecutive positions at: index of each run's first entry, and its length."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (label[1:] != label[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the intervals [start, end); touching ones are one run."""
    if not len(starts):
        return starts.astype(np.int64), ends.astype(np.int64)
    o = np.argsort(starts, kind="stable")
    s, e = starts[o].astype(np.int64), np.maximum.accumulate(ends[o].astype(np.int64))
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
