"""Substring dedup: words covered by a passage of `window` words that also starts in a document with a smaller id.

1. Recurring passages: each window of words names its least-hashed gram of words; windows of one text that share it are
   a segment. Texts are read twice: once for the grams, of which those met in two documents are kept, and once for the segments
   that hold such a gram. Segments of equal content (equal gram hash and equal XXH3 of their words, two unlike hashes) are
   one class with its least id.
2. Automata: the passages of the classes of a gram are compiled into Aho-Corasick automata over word numbers
   (pyahocorasick), each with the least id of its passages. A shard holds whole grams, up to `shard` segments.
3. Streaming: the text of every class is streamed through the automaton of its shard, and every occurrence takes the
   least id. A text meets only the shards its own grams name, so shards and documents don't multiply. What a class
   learns holds for all documents that have it.
4. A gram of over DEAL classes: its passages are first aggregated by their words, map-side, so one in any number of contexts is one row
   with its least id, and those of one document go. What is left is dealt into parts of about DEAL passages, a part's segments
   into slices of about DEAL, and each slice streams through its part's automaton in a group of its own.

Passages in one document only don't count. Null text has no words; a null id is the greatest, and two null ids don't
count against each other; rows of the same id neither. Ties don't arise: the least id alone counts. An empty table gives
an empty result. A very long text is read in pieces that share window - 1 words, so it takes the memory of its bytes and of one
piece. Columns of the input are kept, whatever their names; _words, _spans (runs of removed words) and _kept are added or replaced.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import blocks as B
from rosterlake.llm.keys import Shield, join_hot, schema_of
from rosterlake.llm.order import broadcast_few
from rosterlake.tables import forget, materialise

#: Classes of one gram in a shard; beyond it, passages in an automaton and segments in a slice, about.
DEAL = 2000


def _windows(batches, window: int, gram: int):
    """Segments of each piece of text: rows, its words joined by spaces with their starts and ends, the first word of each text
    there, the word of the text at which the piece begins; row, first window, windows, anchor (in words of the piece), gram hash."""
    w = window - gram + 1
    for rows, buf, off, shift in B.word_pieces(batches, window - 1, "text"):
        if not len(buf):
            continue
        start, end, first = B.words(buf, off)
        at = B.ranges(first[:-1], np.diff(first) - window + 1)
        if not len(at):
            continue
        flat, start, end = B.joined(buf, start, end)
        sums = B.prefix(B.span(B.prefix(B.byte_values(flat)), start, end))
        g = np.arange(len(start) - gram + 1)
        hashes = B.span(sums, g, g + gram)
        p = B.sliding_argmin(hashes, w)[at]
        head, n = B.runs_of(p, at)
        s, p = at[head], p[head]
        yield rows, flat, start, end, first, shift, np.searchsorted(first, s, "right") - 1, s, n, p, hashes[p]


def _grams(window: int, gram: int):
    """Each gram of a piece with the least and the greatest id that has it."""

    def run(batches):
        for rows, *_, d, _, _, _, a in _windows(batches, window, gram):
            ids = rows.column("_id").to_numpy()[d]
            o = np.argsort(a, kind="stable")
            a, ids = a[o], ids[o]
            head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            yield pa.RecordBatch.from_arrays([B.signed(a[head]), pa.array(np.minimum.reduceat(ids, head)), pa.array(np.maximum.reduceat(ids, head))], names=["a", "lo", "hi"])

    return run


def _segments(window: int, gram: int):
    """x holds the first window's word (31 bits), the number of windows and the anchor's offset (16 each)."""

    def run(batches):
        for rows, flat, start, end, first, shift, d, s, n, p, a in _windows(batches, window, gram):
            seg = B.digests(flat.tobytes(), start[s], end[s + n - 2 + window])
            x = (s - first[d] + shift) << 32 | n << 16 | (p - s)
            take = pa.array(d)
            yield pa.RecordBatch.from_arrays([rows.column("_id").take(take), rows.column("_th").take(take), pa.array(x), B.signed(a), B.signed(seg)], names=["_id", "_th", "x", "a", "seg"])

    return run


_CUT = pa.schema([("a", pa.int64()), ("seg", pa.int64()), ("lo", pa.int64()), ("words", pa.string())])


def _cut(window: int, hold: int = 8 << 20):
    """Segments as text."""

    def run(batches):
        for rows, buf, off in B.slices(batches, "text"):
            start, end, first = B.words(buf, off)
            flat, start, end = B.joined(buf, start, end)
            raw = flat.tobytes()
            out, size = {k: [] for k in _CUT.names}, 0
            for i, segs in enumerate(rows.column("segs")):
                for g in segs.as_py():
                    b, n = int(first[i]) + (g["x"] >> 32), g["x"] >> 16 & 0xFFFF
                    text = raw[start[b] : end[b + n - 2 + window]].decode()
                    for k, v in zip(out, (g["a"], g["seg"], g["lo"], text)):
                        out[k].append(v)
                    size += len(text)
                if size > hold:
                    yield pa.RecordBatch.from_pydict(out, schema=_CUT)
                    out, size = {k: [] for k in _CUT.names}, 0
            if size:
                yield pa.RecordBatch.from_pydict(out, schema=_CUT)

    return run


class Finder:
    """An automaton over the numbers of words: passages with the least id of each."""

    def __init__(self, least: dict[tuple[str, ...], int]):
        self.number: dict[str, int] = {}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, lo in least.items():
            self.auto.add_word(tuple(self.number.setdefault(w, len(self.number) + 1) for w in key), lo)
        self.auto.make_automaton()

    def earlier(self, words: list[str], window: int, lo: int) -> list[int]:
        """Windows of a text that are passages of an id under lo; a word that no passage has is 0."""
        return [stop - window + 1 for stop, least in self.auto.iter(tuple(self.number.get(w, 0) for w in words)) if least < lo] if len(self.auto) else []


def _hits(found) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "seg", "j"])


def _shard(window: int, shard: int):
    """Compile and stream one shard after another; rows come sorted by a."""

    def settle(rows: list[dict]):
        texts = [r["words"].split(" ") for r in rows]
        least: dict[tuple, int] = {}
        for r, q in zip(rows, texts):
            for j in range(len(q) - window + 1):
                key = tuple(q[j : j + window])
                if (old := least.get(key)) is None or r["lo"] < old:
                    least[key] = r["lo"]
        finder = Finder(least)
        for r, q in zip(rows, texts):
            for j in finder.earlier(q, window, r["lo"]):
                yield r["a"], r["seg"], j

    def run(batches):
        rows, last = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if len(rows) >= shard and r["a"] != last:
                    yield _hits(settle(rows))
                    rows = []
                rows.append(r)
                last = r["a"]
        if rows:
            yield _hits(settle(rows))

    return run


def _passages(window: int):
    """(a, h, words, lo) of each window of a segment, h a hash of its words."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                rows = batch.slice(i, 4096).to_pylist()
                out = []
                for r in rows:
                    q = r["words"].split(" ")
                    for j in range(len(q) - window + 1):
                        text = " ".join(q[j : j + window])
                        out.append((r["a"], xxhash.xxh3_64_intdigest(text) >> 1, text, r["lo"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["a", "h", "words", "lo"])

    return run


def _parts_of(window: int):
    """A segment once for each part of its gram that one of its windows falls into."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                rows = batch.slice(i, 4096)
                take, part = [], []
                for k, (text, parts) in enumerate(zip(rows.column("words").to_pylist(), rows.column("parts").to_pylist())):
                    q = text.split(" ")
                    mine = {(xxhash.xxh3_64_intdigest(" ".join(q[j : j + window])) >> 1) % parts for j in range(len(q) - window + 1)} if parts > 1 else {0}
                    take += [k] * len(mine)
                    part += sorted(mine)
                names = ["a", "seg", "lo", "words"]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[rows.column(c).take(pa.array(take, pa.int64())) for c in names]], names=["part", *names])

    return run


def _stream(window: int):
    """Groups of (a, part, slice), in order, the passages of the part before the segments of the slice."""

    def run(batches):
        key, least, finder = None, {}, None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if (now := (r["a"], r["part"], r["slice"])) != key:
                    key, least, finder = now, {}, None
                if r["seg"] is None:
                    least[tuple(r["words"].split(" "))] = r["lo"]
                    continue
                finder = finder or Finder(least)
                found += [(r["a"], r["seg"], j) for j in finder.earlier(r["words"].split(" "), window, r["lo"])]
            yield _hits(found)

    return run


def hot_streams(segments: DataFrame, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """segments(a, seg, lo, words), a table, of hot grams -> (a, part, slice, seg, lo, words): the recurring passages of each part (seg
    null), again in each of its slices, and each slice's segments; and the tables that it reads."""
    each = segments.mapInArrow(_passages(window), "a long, h long, words string, lo long")
    each = each.groupBy("a", "h", "words").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi")).where("lo < hi")
    passages = materialise(each.select("a", "h", "words", "lo"), "passages")
    parts = materialise(passages.groupBy("a").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("parts")), "parts")
    dealt = segments.join(broadcast_few(parts), "a").mapInArrow(_parts_of(window), "part int, a long, seg long, lo long, words string")
    dealt = materialise(dealt, "dealt")
    slices = materialise(dealt.groupBy("a", "part").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("slices")), "slices")
    own = dealt.join(broadcast_few(slices), ["a", "part"]).select("a", "part", F.pmod(F.xxhash64("seg"), F.col("slices")).cast("int").alias("slice"), "seg", "lo", "words")
    said = passages.join(broadcast_few(parts), "a").withColumn("part", (F.col("h") % F.col("parts")).cast("int")).join(broadcast_few(slices), ["a", "part"])
    said = said.select("a", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("seg"), "lo", "words")
    return own.unionByName(said), [passages, parts, dealt, slices]


def _finish(window: int):
    def run(batches):
        for rows, buf, off in B.slices(batches, "text"):
            start, end, first = B.words(buf, off)
            spans, kept, count = [], [], np.diff(first)
            flat, at, to = B.joined(buf, start, end)
            raw = flat.tobytes()
            for i, segs in enumerate(rows.column("segs")):
                b, e = int(first[i]), int(first[i + 1])
                runs, edge = [], [b, e]
                if segs.is_valid and len(segs.values):
                    s = np.asarray(segs.values.field("s"), np.int64)
                    lo, hi = B.union(s, s + np.asarray(segs.values.field("n"), np.int64) - 1 + window)
                    runs = [{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)]
                    edge = [b, *(b + int(v) for pair in zip(lo, hi) for v in pair), e]
                spans.append(runs)
                kept.append(b" ".join(raw[at[u] : to[v - 1]] for u, v in zip(edge[::2], edge[1::2]) if u < v).decode())
            names = [x for x in rows.schema.names if x not in ("segs", "_id", "_th")]
            arrays = [rows.column(x) for x in names]
            arrays += [pa.array(count.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "_words", "_spans", "_kept"])

    return run


def repeated_passages(docs: DataFrame, window: int = 13, gram: int = 4, shard: int = 4000) -> DataFrame:
    """keyed(docs) with a column text -> (_id, _th, s, n), a table: windows that start at words s to s + n - 1 go."""
    if not 1 <= gram <= window <= 65_535:
        raise ValueError("a window has a gram of one word or more, and 65,535 words at most")
    src = docs.select("_id", "_th", "text")
    met = src.mapInArrow(_grams(window, gram), "a long, lo long, hi long").groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    again = materialise(met.where("lo < hi").select("a"), "recurring")
    found = materialise(src.mapInArrow(_segments(window, gram), "_id long, _th long, x long, a long, seg long").join(again, "a", "left_semi"), "candidates")
    classes = materialise(found.groupBy("a", "seg").agg(F.count("*").alias("c"), F.min(F.struct("_id", "_th", "x")).alias("r")), "classes")
    many = classes.groupBy("a").agg(F.count("*").alias("k")).where("k > 1")
    many = materialise(many, "grams")

    def cut(grams: DataFrame) -> DataFrame:
        need = classes.join(grams, "a", "left_semi").select("r._id", "r._th", F.struct("r.x", "a", "seg", F.col("r._id").alias("lo")).alias("g"))
        need = need.groupBy("_id", "_th").agg(F.collect_list("g").alias("segs"))
        return src.join(need, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).mapInArrow(_cut(window), "a long, seg long, lo long, words string")

    texts = cut(many.where(F.col("k") <= DEAL)).repartition("a").sortWithinPartitions("a")
    met, made = texts.mapInArrow(_shard(window, shard), "a long, seg long, j int"), [again, found, classes, many]
    if many.where(F.col("k") > DEAL).limit(1).count():
        segments = materialise(cut(many.where(F.col("k") > DEAL)), "segments")
        streams, tables = hot_streams(segments, window)
        on = ["a", "part", "slice"]
        met = met.unionByName(streams.repartition(*on).sortWithinPartitions(*on, F.col("seg").asc_nulls_first()).mapInArrow(_stream(window), "a long, seg long, j int"))
        made += [segments, *tables]
    met = met.groupBy("a", "seg").agg(F.collect_set("j").alias("js"))
    verdict = materialise(classes.select("a", "seg", "c", F.col("r._id").alias("lo")).join(met, ["a", "seg"], "left"), "verdicts")
    at, n = F.shiftright("x", 32).cast("int"), F.shiftright("x", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    j = join_hot(found, verdict, ["a", "seg"], "inner").select("_id", "_th", at.alias("s"), n.alias("n"), "lo", "js")
    # a later document loses the whole segment, the first one the windows that an earlier document has in another class
    run = F.when(F.col("_id") > F.col("lo"), F.array(F.struct("s", "n"))).otherwise(F.transform("js", lambda k: F.struct((F.col("s") + k).alias("s"), F.lit(1).alias("n"))))
    out = materialise(j.where("_id > lo or js is not null").select("_id", "_th", F.explode(run).alias("r")).select("_id", "_th", "r.s", "r.n"), "passages")
    forget(*made, verdict)
    return out


def phrase_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 13, gram: int = 4, shard: int = 4000) -> DataFrame:
    """docs with _words (count), _spans (array of struct<start,end> in words) and _kept (the words left, joined by one
    space)."""
    shield = Shield(docs, text_col, id_col)
    src = shield.keyed()
    per = repeated_passages(src, window, gram, shard).groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "n")).alias("segs"))
    full = src.join(per, ["_id", "_th"], "left")
    out = full.mapInArrow(_finish(window), schema_of(full, "segs", "_id", "_th") + ", _words bigint, _spans array<struct<start:bigint,end:bigint>>, _kept string")
    return shield.restore(out, "_words", "_spans", "_kept")
