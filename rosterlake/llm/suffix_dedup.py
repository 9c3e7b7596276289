"""Suffix-array dedup: bytes covered by a repeated string of min_bytes bytes.

All suffixes of a corpus are far more than the corpus, so the array is sparse and still exact:

1. Every window of min_bytes bytes names an anchor, the least-hashed gram in it; equal windows name the same gram at
   the same offset. Windows of one text that share an anchor are a segment. Texts are read twice: once for the grams, of which
   those met twice or more are kept, and once for the segments that hold such a gram.
2. Segments with equal content (equal gram hash and equal XXH3 of their bytes, two unlike hashes) are one class with a
   multiplicity: copies are settled by it, all windows repeated.
3. A class alone in its content, beside other classes of its gram, goes to the suffix array: sampled splitters range-
   partition by the leading bytes at the anchor, a bucket sorts its window suffixes by multikey refinement, eight-byte
   token by token, and equal neighbours at full depth are repeats. Splitters are leading bytes, so a run of equal
   leading bytes never crosses a boundary: neighbours across one differ within the leading token, which is the whole
   comparison there; there is a range for about TASK windows. A gram with very many classes is dealt by ranges of the window
   offset (equal windows have equal offsets), and each range by the bytes that all its windows share.
4. What these bytes leave together in a bucket of over 2 * DEAL rows are contexts of one passage: there each window is told by its
   anchor, offset and two unlike hashes, and equal windows are counted map-side before anything is shuffled, so a passage in any
   number of contexts is one row of each task and never a bucket.

Matches never cross documents; they may overlap, and lie within one document. Null text counts as empty; a text shorter
than min_bytes is kept whole; repeated rows are copies of each other, and no result depends on the order of ties; a null id
is an id like another; an empty table gives an empty result. A very long text is read in pieces that share min_bytes - 1
bytes, so it takes the memory of its bytes and of one piece. Columns of the input are kept, whatever their names; those
added are _spans and _kept (replaced if there).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import blocks as B
from rosterlake.llm.keys import Shield, join_hot, schema_of
from rosterlake.llm.order import broadcast_few
from rosterlake.tables import forget, materialise

#: Classes of one gram in a bucket, about; beyond it the gram is dealt by window offset.
DEAL = 2000
LEAD = 32
#: Windows that a task of the sort gets, about.
TASK = 600_000


def _windows(batches, min_bytes: int, gram: int):
    """Segments of each piece of text: rows, row of each, first window, windows, anchor (in bytes of the piece), gram hash."""
    w = min_bytes - gram + 1
    for rows, buf, off, shift in B.pieces(batches, min_bytes - 1, "text"):
        if len(buf) < min_bytes:
            continue
        at = B.ranges(off[:-1], np.diff(off) - min_bytes + 1)
        if not len(at):
            continue
        sums = B.prefix(B.byte_values(buf))
        grams = np.arange(len(buf) - gram + 1)
        hashes = B.span(sums, grams, grams + gram)
        p = B.sliding_argmin(hashes, w)[at]
        first, n = B.runs_of(p, at)
        s, p = at[first], p[first]
        yield rows, buf, off, shift, np.searchsorted(off, s, "right") - 1, s, n, p, hashes[p]


def _grams(min_bytes: int, gram: int):
    def run(batches):
        for *_, a in _windows(batches, min_bytes, gram):
            a, k = np.unique(a, return_counts=True)
            yield pa.RecordBatch.from_arrays([B.signed(a), pa.array(k)], names=["a", "k"])

    return run


def _segments(min_bytes: int, gram: int):
    """x holds the first window's byte (31 bits), the number of windows and the anchor's offset (16 each)."""

    def run(batches):
        for rows, buf, off, shift, d, s, n, p, a in _windows(batches, min_bytes, gram):
            seg = B.digests(buf.tobytes(), s, s + n - 1 + min_bytes)
            x = (s - off[d] + shift) << 32 | n << 16 | (p - s)
            take = pa.array(d)
            yield pa.RecordBatch.from_arrays([rows.column("_id").take(take), rows.column("_th").take(take), pa.array(x), B.signed(a), B.signed(seg)], names=["_id", "_th", "x", "a", "seg"])

    return run


_CUT = pa.schema([("lead", pa.binary()), ("part", pa.int32()), ("core", pa.int64()), ("text", pa.binary()), ("a", pa.int64()), ("_id", pa.int64()), ("_th", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("p", pa.int32()), ("lone", pa.bool_())])


def _cut(min_bytes: int, gram: int, hold: int = 8 << 20):
    """Segment texts of the classes in question, dealt by window offset where their gram is hot."""
    width, lead = min_bytes - gram + 1, min(LEAD, gram)  # all windows of an anchor hold its gram, and no byte beyond is in all

    def run(batches):
        for rows, buf, off in B.slices(batches, "text"):
            out, size = {k: [] for k in _CUT.names}, 0
            ids, ths = rows.column("_id").to_pylist(), rows.column("_th").to_pylist()
            for i, segs in enumerate(rows.column("segs")):
                for g in segs.as_py():
                    s, n, p = g["x"] >> 32, g["x"] >> 16 & 0xFFFF, g["x"] & 0xFFFF
                    text = buf[off[i] + s : off[i] + s + n - 1 + min_bytes].tobytes()
                    parts = min(width, -(-g["k"] // DEAL))
                    low, high = max(0, p - n + 1), p  # offsets of the anchor in this segment's windows
                    for part in range(low * parts // width, high * parts // width + 1):
                        least, most = -(-part * width // parts), -(-(part + 1) * width // parts) - 1
                        core = xxhash.xxh3_64_intdigest(text[p - least : p - most + min_bytes]) - (1 << 63)  # in every window of this part
                        first, last = max(0, p - most), min(n - 1, p - least)  # windows of this part; no other goes with it
                        own = text[first : last + min_bytes]
                        for k, v in zip(out, (text[p : p + lead], part * 65536 + parts, core, own, g["a"], ids[i], ths[i], s + first, last - first + 1, p - first, g["c"] == 1)):
                            out[k].append(v)
                        size += len(own)
                    if size > hold:
                        yield pa.RecordBatch.from_pydict(out, schema=_CUT)
                        out, size = {k: [] for k in _CUT.names}, 0
            if size:
                yield pa.RecordBatch.from_pydict(out, schema=_CUT)

    return run


def multikey_sort(buf: np.ndarray, starts: np.ndarray, depth: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of buf at starts, ordered by their first depth bytes within each group: multikey refinement, which
    orders a run of equal keys by the next eight-byte token and leaves a suffix alone once no neighbour equals it.
    Returns those that still have an equal neighbour at full depth, and the label of their run."""
    idx, run = np.arange(len(starts)), group
    tokens = np.lib.stride_tricks.sliding_window_view(buf, 8)
    for at in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        if not len(idx):
            break
        key = np.ascontiguousarray(tokens[starts[idx] + at]).view(">u8").ravel().astype(np.uint64)
        o = np.lexsort((key, run))
        idx, key, run = idx[o], key[o], run[o]
        new = np.ones(len(idx), bool)
        new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        label = np.cumsum(new) - 1
        again = np.bincount(label)[label] > 1
        idx, run = idx[again], label[again]
    return idx, run


def _bucket(min_bytes: int, gram: int, hold: int = 3 << 20):
    """One bucket after another: runs of equal leading bytes are sorted together, about hold bytes at a time."""
    width = min_bytes - gram + 1

    def settle(rows: list[dict]):
        texts = [r["text"] for r in rows]
        base = np.cumsum([0, *map(len, texts)])
        buf = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
        n = np.array([r["n"] for r in rows])
        p = np.array([r["p"] for r in rows])
        row = np.repeat(np.arange(len(rows)), n)
        rel = B.ranges(np.zeros(len(rows), np.int64), n)
        d = p[row] - rel
        _, gid = np.unique(np.array([r["a"] for r in rows], np.int64), return_inverse=True)
        group = gid[row] * np.int64(width) + d
        idx, _ = multikey_sort(buf, base[row] + rel, min_bytes, group)
        lone = np.array([r["lone"] for r in rows])
        hit = np.zeros(len(row), bool)
        hit[idx] = True
        hit &= lone[row]
        row, rel = row[hit], rel[hit]
        first, count = B.runs_of(row, rel)
        return [(rows[row[f]]["_id"], rows[row[f]]["_th"], int(rows[row[f]]["s"] + rel[f]), int(c)) for f, c in zip(first, count)]

    def run(batches):
        rows, size, last = [], 0, None

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["_id", "_th", "s", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["lead"], r["part"], r["core"])
                if size > hold and now != last:
                    yield out(settle(rows))
                    rows, size = [], 0
                rows.append(r)
                size += len(r["text"])
                last = now
        if rows:
            yield out(settle(rows))

    return run


def _hot_windows(min_bytes: int):
    """Every window of a row: anchor, offset, two unlike hashes of its bytes, where it starts."""
    names = ["a", "d", "h", "g", "_id", "_th", "s", "lone"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                buf, off = B.column_bytes(rows.column("text"))
                if not len(buf):
                    continue
                n, p = (rows.column(c).to_numpy() for c in ("n", "p"))
                row = np.repeat(np.arange(rows.num_rows), n)
                rel = B.ranges(np.zeros(rows.num_rows, np.int64), n)
                d = p[row] - rel
                at = off[row] + rel
                sums = B.prefix(B.byte_values(buf))
                take = pa.array(row)
                own = [rows.column(c).take(take) for c in ("a", "_id", "_th", "s", "lone")]
                found = B.signed(B.span(sums, at, at + min_bytes)), B.signed(B.digests(buf.tobytes(), at, at + min_bytes))
                start = pa.array((own[3].to_numpy() + rel).astype(np.int32))
                yield pa.RecordBatch.from_arrays([own[0], pa.array(d.astype(np.int32)), *found, own[1], own[2], start, own[4]], names=names)

    return run


def hot_buckets(texts: DataFrame) -> DataFrame:
    """(lead, part, core) of the buckets of over 2 * DEAL rows, a table: one row for at least as many rows of texts."""
    return materialise(texts.groupBy("lead", "part", "core").agg(F.count("*").alias("k")).where(F.col("k") > 2 * DEAL).select("lead", "part", "core"), "hot")


def in_ranges(cool: DataFrame) -> DataFrame:
    """cool in ranges of its leading bytes, sorted. Their number follows the windows: ranges that Spark may put together, up to a
    size in bytes, make tasks as long as that size, whatever the number of machines."""
    ranges = -(-(cool.agg(F.sum("n")).first()[0] or 1) // TASK)
    return cool.repartitionByRange(ranges, "lead", "part", "core").sortWithinPartitions("lead", "part", "core")


def _finish(min_bytes: int, with_text: bool):
    def run(batches):
        for rows, buf, off in B.slices(batches, "text"):
            spans, kept, text = [], [], []
            for i, segs in enumerate(rows.column("segs")):
                b, e = int(off[i]), int(off[i + 1])
                if not segs.is_valid or len(segs.values) == 0:
                    spans.append([])
                    kept.append(buf[b:e].tobytes())
                    text.append(kept[-1].decode() if with_text else "")
                    continue
                s = np.asarray(segs.values.field("s"), np.int64)
                lo, hi = B.union(s, s + np.asarray(segs.values.field("n"), np.int64) - 1 + min_bytes)
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
                edge = [0, *(int(v) for pair in zip(lo, hi) for v in pair), e - b]
                parts = [buf[b + x : b + y].tobytes() for x, y in zip(edge[::2], edge[1::2])]
                kept.append(b"".join(parts))
                # bytes left of a character that a cut splits are no text
                text.append("".join(x.decode("utf-8", "ignore") for x in parts) if with_text else "")
            names = [x for x in rows.schema.names if x not in ("segs", "_id", "_th")]
            arrays = [rows.column(x) for x in names]
            arrays += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), *([pa.array(text, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "_spans", "_kept", *(["_kept_text"] if with_text else [])])

    return run


def repeated_windows(docs: DataFrame, min_bytes: int = 400, gram: int = 208) -> DataFrame:
    """keyed(docs) with a column text -> (_id, _th, s, n), a table: windows that start at bytes s to s + n - 1 are repeated."""
    if not 8 <= gram <= min_bytes <= 65_535:
        raise ValueError("a window has a gram of 8 bytes or more and 65,535 bytes at most")
    src = docs.select("_id", "_th", "text")
    again = materialise(src.mapInArrow(_grams(min_bytes, gram), "a long, k long").groupBy("a").agg(F.sum("k").alias("k")).where("k > 1").select("a"), "grams")
    found = materialise(src.mapInArrow(_segments(min_bytes, gram), "_id long, _th long, x long, a long, seg long").join(again, "a", "left_semi"), "candidates")
    classes = materialise(found.groupBy("a", "seg").agg(F.count("*").alias("c"), F.min(F.struct("_id", "_th", "x")).alias("r")), "classes")
    copies = join_hot(found, classes.where("c > 1").select("a", "seg", "c"), ["a", "seg"], "left_semi").select("_id", "_th", "x")
    copies = copies.select("_id", "_th", F.shiftright("x", 32).cast("int").alias("s"), F.shiftright("x", 16).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("n"))
    open_ = classes.groupBy("a").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1").select("a", "k")
    need = classes.join(open_, "a").select("r._id", "r._th", F.struct("r.x", "a", "c", "k").alias("g"))
    need = need.groupBy("_id", "_th").agg(F.collect_list("g").alias("segs"))
    one = src.join(need, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
    texts = materialise(one.mapInArrow(_cut(min_bytes, gram), "lead binary, part int, core long, text binary, a long, _id long, _th long, s int, n int, p int, lone boolean"), "suffixes")
    hot, on = hot_buckets(texts), ["lead", "part", "core"]
    cool = texts.join(broadcast_few(hot), on, "left_anti")
    parts = [copies, in_ranges(cool).mapInArrow(_bucket(min_bytes, gram), "_id long, _th long, s int, n int")]
    made = [again, found, classes, texts, hot]
    if hot.limit(1).count():
        every = texts.join(broadcast_few(hot), on, "left_semi").mapInArrow(_hot_windows(min_bytes), "a long, d int, h long, g long, _id long, _th long, s int, lone boolean")
        every = materialise(every, "contexts")
        twice = materialise(every.groupBy("a", "d", "h", "g").agg(F.count("*").alias("c")).where("c > 1"), "twice")
        parts.append(join_hot(every.where("lone"), twice, ["a", "d", "h", "g"], "left_semi").select("_id", "_th", "s", F.lit(1).alias("n")))
        made += [every, twice]
    out = materialise(reduce(DataFrame.union, parts), "windows")
    forget(*made)
    return out


def suffix_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_bytes: int = 400, gram: int | None = None, with_text: bool = False) -> DataFrame:
    """docs with _spans (array of struct<start,end>, the removed byte runs, maximal, in order) and _kept (binary,
    the other bytes of the UTF-8 text); with_text adds _kept_text, whole characters only. min_bytes is 16 or more; gram,
    8 or more and less than it, only sets the sampling."""
    gram = gram or (min_bytes * 13) // 25
    shield = Shield(docs, text_col, id_col)
    src = shield.keyed()
    per = repeated_windows(src, min_bytes, gram)
    per = per.groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "n")).alias("segs"))
    full = src.join(per, ["_id", "_th"], "left")
    out = full.mapInArrow(_finish(min_bytes, with_text), schema_of(full, "segs", "_id", "_th") + ", _spans array<struct<start:bigint,end:bigint>>, _kept binary" + ", _kept_text string" * with_text)
    return shield.restore(out, "_spans", "_kept", *(["_kept_text"] if with_text else []))
