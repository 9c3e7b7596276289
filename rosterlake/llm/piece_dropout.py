"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is a space, then its characters, spaces as U+2581. Symbols are merged by an agenda: of all neighbours whose join is
a piece, the one of best score (then leftmost) first. Each candidate, when it enters the agenda, is skipped for good
if its keyed hash (seed, the document's variant, the unit it stands in, its place, its two symbols) falls below `dropout`: the
same key always gives the same segmentation, another variant another. dropout 0 is the plain encoding. What the
vocabulary can't spell becomes byte pieces, so decoding gives back the exact text, with or without dropout.

No piece goes from a non-space on to a space, or over a control character, so a text falls into units (spaces, then
other characters) that don't affect each other. A unit of over SHORT characters (text without spaces) is cut once more,
between two characters that follow each other in no piece. Equal units of one variant are merged once per slice; they are found by
a hash and then compared byte by byte. Short ones are merged side by side in arrays, longer ones by a heap, in n log n steps.

Null and empty texts have no pieces; a literal U+2581 becomes bytes, so it isn't taken for a space; equal scores of neighbours
go to the left one; repeated rows encode alike; an empty table gives an empty result; a very long text is a slice of its own and
takes about 60 bytes a byte. Columns of the input are kept, whatever their names; _pieces is added or replaced. The model's path is a
parameter and must be readable by the driver only.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import blocks as B
from rosterlake.llm.keys import Shield, schema_of

U = np.uint64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = np.int32(2**31 - 1)
SHORT = 48
#: Bytes of text that are encoded at once: what a worker holds beside its batches.
SLICE = 512 << 10


@dataclass
class Pieces:
    """A model as arrays: joins (sorted keys left << 32 | right, the piece, its rank; the lower the sooner), single
    characters, bytes of each piece."""

    join_keys: np.ndarray
    join_piece: np.ndarray
    join_rank: np.ndarray
    chars: np.ndarray
    char_piece: np.ndarray
    byte_piece: np.ndarray
    data: np.ndarray
    data_off: np.ndarray
    size: int
    #: sorted keys left << 32 | right of the code points that follow each other in some piece
    pairs: np.ndarray
    #: the joins by key, made where a long unit needs them
    table: dict | None = None


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    ids, byte_piece, raw = {}, np.zeros(256, np.int32), [b""] * n
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_piece[int(p[3:5], 16)] = i
            raw[i] = bytes([int(p[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[p] = i
            raw[i] = p.replace("▁", " ").encode()
    rank = {i: r for r, i in enumerate(sorted(ids.values(), key=lambda i: (-sp.get_score(i), i)))}
    rows = sorted((ids[p[:k]] << 32 | ids[p[k:]], i, rank[i]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
    if any("▁" in p.lstrip("▁") for p in ids):
        raise ValueError("a piece goes on to a space: units can't be told apart")
    single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
    keys, piece, order = (np.array(x) for x in zip(*rows))
    chars, char_piece = (np.array(x) for x in zip(*single))
    off = np.cumsum([0, *map(len, raw)])
    pairs = np.array(sorted({ord(a) << 32 | ord(b) for p in ids for a, b in zip(p, p[1:])}), np.int64)
    return Pieces(keys.astype(U), piece.astype(np.int32), order.astype(np.int32), chars.astype(np.int64), char_piece.astype(np.int32), byte_piece, np.frombuffer(b"".join(raw), np.uint8), off, n, pairs)


def _joins(m: Pieces, left: np.ndarray, right: np.ndarray, salt: np.ndarray, place: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Rank and piece of each pair's join; rank NONE if there is none or its keyed hash drops it."""
    key = left.astype(np.int64).astype(U) << U(32) | right.astype(np.int64).astype(U)
    at = np.minimum(np.searchsorted(m.join_keys, key), len(m.join_keys) - 1)
    rank = np.where(m.join_keys[at] == key, m.join_rank[at], NONE)
    if dropout > 0:
        h = B.mix(salt ^ B.mix(key + place.astype(U) * U(0x9E3779B97F4A7C15)))
        rank = np.where((h >> U(11)).astype(np.float64) * 2.0**-53 < dropout, NONE, rank)
    return rank, m.join_piece[at]


def merge_rows(m: Pieces, sym: np.ndarray, length: np.ndarray, salt: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """sym (units, width): each row's first length symbols, merged; all rows take their best join, step by step."""
    n, width = sym.shape
    sym, length, out_len = sym.copy(), length.copy(), length.copy()
    if width < 2:
        return sym, length
    place = np.tile(np.arange(width, dtype=np.int64), (n, 1))
    out = sym.copy()
    live = np.arange(n)
    valid = np.arange(width - 1)[None, :] + 1 < length[:, None]
    rank, piece = np.full((n, width - 1), NONE), np.zeros((n, width - 1), np.int32)
    r, c = np.nonzero(valid)
    rank[r, c], piece[r, c] = _joins(m, sym[r, c], sym[r, c + 1], salt[r], place[r, c], dropout)
    cols = np.arange(width)
    while len(live):
        j = rank.argmin(1)
        best = rank[np.arange(len(live)), j]
        done = best == NONE
        if done.any():
            out[live[done]], out_len[live[done]] = sym[done], length[done]
            keep = ~done
            live, sym, place, rank, piece, length, salt, j = live[keep], sym[keep], place[keep], rank[keep], piece[keep], length[keep], salt[keep], j[keep]
            if not len(live):
                break
        rows = np.arange(len(live))
        sym[rows, j] = piece[rows, j]
        src = np.minimum(cols[None, :] + (cols[None, :] > j[:, None]), width - 1)
        sym, place = np.take_along_axis(sym, src, 1), np.take_along_axis(place, src, 1)
        pair = np.minimum(cols[None, :-1] + (cols[None, :-1] > j[:, None]), width - 2)
        rank, piece = np.take_along_axis(rank, pair, 1), np.take_along_axis(piece, pair, 1)
        length -= 1
        rank[rows, np.minimum(length - 1, width - 2)] = NONE
        for c in (j - 1, j):
            ok = np.flatnonzero((c >= 0) & (c + 1 < length))
            if len(ok):
                k = c[ok]
                rank[ok, k], piece[ok, k] = _joins(m, sym[ok, k], sym[ok, k + 1], salt[ok], place[ok, k], dropout)
    return out, out_len


_MASK = (1 << 64) - 1


def _mix1(h: int) -> int:
    """B.mix of one number."""
    h ^= h >> 31
    h = h * 0xD6E8FEB86659FD93 & _MASK
    h ^= h >> 32
    h = h * 0xA0761D6478BD642F & _MASK
    return h ^ h >> 29


def merge_long(m: Pieces, sym: np.ndarray, salt: int, dropout: float) -> np.ndarray:
    """One long unit by a heap of candidates: n log n steps."""
    n = len(sym)
    if n < 2:
        return sym
    if m.table is None:
        m.table = {k: (r, p) for k, r, p in zip(m.join_keys.tolist(), m.join_rank.tolist(), m.join_piece.tolist())}
    table, limit = m.table, dropout * 2.0**53
    s = sym.tolist()
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    rank, piece = _joins(m, sym[:-1], sym[1:], np.full(n - 1, salt, U), np.arange(n - 1), dropout)
    heap = [(int(rank[a]), a, a + 1, s[a], s[a + 1], int(piece[a])) for a in np.flatnonzero(rank != NONE).tolist()]
    heapq.heapify(heap)
    while heap:
        _, a, b, x, y, p = heapq.heappop(heap)
        if not (alive[a] and alive[b] and s[a] == x and s[b] == y and right[a] == b):
            continue
        s[a], alive[b] = p, False
        right[a] = right[b]
        if right[b] >= 0:
            left[right[b]] = a
        for c in (left[a], a):
            d = right[c] if c >= 0 else -1
            if d < 0:
                continue
            key = s[c] << 32 | s[d]
            if (found := table.get(key)) is None:
                continue
            if dropout > 0 and _mix1(salt ^ _mix1(key + c * 0x9E3779B97F4A7C15 & _MASK)) >> 11 < limit:
                continue
            heapq.heappush(heap, (found[0], c, d, s[c], s[d], found[1]))
    return np.array([x for x, ok in zip(s, alive) if ok], np.int64)


def _code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and where each starts."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    b = np.append(buf, np.zeros(4, np.uint8)).astype(np.int64)
    x = b[at]
    two = (x & 0x1F) << 6 | b[at + 1] & 0x3F
    three = (x & 0x0F) << 12 | (b[at + 1] & 0x3F) << 6 | b[at + 2] & 0x3F
    four = (x & 0x07) << 18 | (b[at + 1] & 0x3F) << 12 | (b[at + 2] & 0x3F) << 6 | b[at + 3] & 0x3F
    return np.where(x < 0x80, x, np.where(x < 0xE0, two, np.where(x < 0xF0, three, four))), at


def _cut_long(m: Pieces, units: np.ndarray, code: np.ndarray, at: np.ndarray, stop: int) -> np.ndarray:
    """units with those of over SHORT characters cut where no piece can go on."""
    first = np.searchsorted(at, units)
    count = np.diff(np.append(first, len(at)))
    long = np.flatnonzero(count > SHORT)
    if not len(long) or not len(m.pairs):
        return units
    inner = B.ranges(first[long] + 1, count[long] - 1)
    pair = code[inner - 1] << 32 | code[inner]
    known = m.pairs[np.minimum(np.searchsorted(m.pairs, pair), len(m.pairs) - 1)] == pair
    return np.union1d(units, at[inner[~known]])


def equal_units(text: np.ndarray, units: np.ndarray, ends: np.ndarray, key: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each different unit, and of each unit the place of its representative. Units of equal key are
    compared; one that differs from its representative represents itself."""
    _, idx, inverse = np.unique(key, return_index=True, return_inverse=True)
    size, of = ends - units, idx[inverse]
    same = (size == size[of]) & (variant == variant[of])
    fit = np.flatnonzero(same)
    if len(fit):
        equal = text[B.ranges(units[fit], size[fit])] == text[B.ranges(units[of[fit]], size[fit])]
        edge = np.cumsum(size[fit]) - size[fit]
        same[fit] = np.logical_and.reduceat(equal, edge)
    odd = np.flatnonzero(~same)
    inverse = inverse.copy()
    inverse[odd] = len(idx) + np.arange(len(odd))
    return np.append(idx, odd), inverse


def encode_slice(m: Pieces, buf: np.ndarray, off: np.ndarray, variant: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts, concatenated, and the offsets of each text's."""
    n = len(off) - 1
    size = np.diff(off)
    full = np.flatnonzero(size)
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    new_size = size[full] + 1
    begin = np.cumsum(new_size) - new_size
    text = np.full(int(new_size.sum()), 32, np.uint8)
    text[B.ranges(begin + 1, size[full])] = buf
    space, control = text == 32, (text >= 9) & (text <= 13)
    start = control.copy()
    start[1:] |= (space[1:] & ~space[:-1]) | control[:-1]
    start[begin] = True
    code, at = _code_points(text)
    code = np.where(code == 0x2581, -1, np.where(code == 32, 0x2581, code))
    units = _cut_long(m, np.flatnonzero(start), code, at, len(text))
    ends = np.append(units[1:], len(text))
    doc = full[np.searchsorted(begin, units, "right") - 1]
    salt = B.mix(variant[doc].astype(U) + U(seed * 0xD1B54A32D192ED03 % (1 << 64)))
    salt = B.mix(B.span(B.prefix(B.byte_values(text)), units, ends) ^ salt)
    idx, inverse = equal_units(text, units, ends, salt, variant[doc])
    uniq = salt[idx]
    a, b = np.searchsorted(at, units[idx]), np.searchsorted(at, ends[idx])
    where = np.minimum(np.searchsorted(m.chars, code), len(m.chars) - 1)
    # a character that isn't a piece stands for itself, past the vocabulary
    sym = np.where(m.chars[where] == code, m.char_piece[where], m.size + np.where(code == -1, 0x2581, code))
    count = b - a
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 20), (20, SHORT)):
        pick = np.flatnonzero((count > lo) & (count <= hi))
        for i in range(0, len(pick), 20_000):
            p = pick[i : i + 20_000]
            width = int(count[p].max())
            rows = sym[a[p][:, None] + np.minimum(np.arange(width), count[p][:, None] - 1)]
            merged, length = merge_rows(m, rows, count[p], uniq[p], dropout)
            got.append((p, merged[np.arange(width)[None, :] < length[:, None]], length))
    for p in np.flatnonzero(count > SHORT):
        merged = merge_long(m, sym[a[p] : b[p]], int(uniq[p]), dropout)
        got.append((np.array([p]), merged, np.array([len(merged)])))
    owner = np.concatenate([np.repeat(p, ln) for p, _, ln in got])
    flat = np.concatenate([x for _, x, _ in got])[np.argsort(owner, kind="stable")]
    length = np.bincount(owner, minlength=len(uniq))
    flat, length = _spell(m, flat, length)
    base = np.cumsum(length) - length
    out = flat[B.ranges(base[inverse], length[inverse])]
    per = np.bincount(doc, length[inverse], n).astype(np.int64)
    return out.astype(np.int32), np.append(0, np.cumsum(per))


def _spell(m: Pieces, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters past the vocabulary as byte pieces."""
    odd = np.flatnonzero(flat >= m.size)
    if not len(odd):
        return flat, length
    spelt = [m.byte_piece[np.frombuffer(chr(int(c)).encode(), np.uint8)] for c in flat[odd] - m.size]
    times = np.ones(len(flat), np.int64)
    times[odd] = [len(x) for x in spelt]
    out = np.repeat(flat, times)
    out[B.ranges((np.cumsum(times) - times)[odd], times[odd])] = np.concatenate(spelt)
    return out, np.bincount(np.repeat(np.repeat(np.arange(len(length)), length), times), minlength=len(length))


def decode_slice(m: Pieces, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, concatenated, and their offsets: the pieces' bytes without the first space of each text."""
    size = np.diff(m.data_off)[ids]
    out = m.data[B.ranges(m.data_off[ids], size)]
    ends = np.append(0, np.cumsum(size))[off]
    has = np.flatnonzero(np.diff(ends))
    drop = np.ones(len(out), bool)
    drop[ends[has]] = False
    return out[drop], ends - np.append(0, np.cumsum(np.diff(ends) > 0))


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", dropout: float = 0.1, seed: int = 29, variants: int | None = 8, model: str = MODEL) -> DataFrame:
    """docs with _pieces (array<int>). A row's variant is a keyed hash of its id, one of `variants` many; with None each id has its own, which shares less work."""
    m = load(model)
    shield = Shield(docs, text_col, id_col)
    names = shield.own
    variant = F.xxhash64(F.lit(seed), F.col(shield.id).cast("string"))
    variant = (F.pmod(variant, F.lit(variants)) if variants else variant).alias("_variant")

    def run(batches):
        for rows, buf, off in B.slices(batches, "text", SLICE):
            v = rows.column("_variant").to_numpy(zero_copy_only=False)
            ids, at = encode_slice(m, buf, off, v, dropout, seed)
            pieces = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pieces], names=[*names, "_pieces"])

    return shield.restore(shield.df.select(*names, variant).mapInArrow(run, schema_of(shield.df) + ", _pieces array<int>"), "_pieces")


def decode(rows: DataFrame, pieces_col: str = "_pieces", out_col: str = "_decoded", model: str = MODEL) -> DataFrame:
    """rows with the text of their pieces; null pieces give an empty text."""
    m = load(model)
    shield = Shield(rows, pieces_col)
    names = shield.own

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(part.schema.get_field_index("text"))
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                data, off = decode_slice(m, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(size)))
                text = pa.StringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], text], names=[*names, "_out"])

    out = shield.df.mapInArrow(run, schema_of(shield.df) + ", _out string")
    return out.select(*[F.col(c).alias(n) for c, n in zip(shield.own, shield.names) if n != out_col], F.col("_out").alias(out_col))
