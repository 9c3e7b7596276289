"""One large JSON array read by many tasks.

A file, a bare array of objects or an object with such an array under a key, is read in splits by Spark's own text reader, cut at closing braces.
Whether a brace counts depends on what comes before it, so there are two passes: first each split says what it does to the state of the
scan (how deep it is, and whether it is inside a string), for both states it may begin in; these few rows, one a split, put in order, give the
state at each split's start. Then each split cuts its objects. One that lies across splits comes in parts, which are put together by
their place.

A file that doesn't close what it opens has no objects; values of the array that aren't objects are skipped.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"\\.", re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*"?', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{\[\]]', re.S)


def _blocks(batches):
    """(file, block, rows of text) of consecutive chunks of one split, batch by batch."""
    for batch in batches:
        files, blocks, values = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        at = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], blocks[i]) != (files[at], blocks[at]):
                yield files[at], blocks[at], values[at:i]
                at = i


def _depth(parts: list[str]) -> int:
    return sum(p.count("{") + p.count("[") - p.count("]") for p in parts)


class _Scan:
    """The state of a scan after some chunks: depth, and whether it is inside a string. Each chunk ends at a brace."""

    def __init__(self, depth: int = 0, inside: bool = False):
        self.depth, self.inside = depth, inside

    def over(self, chunk: str) -> None:
        plain = (_ESCAPE.sub("", chunk) if "\\" in chunk else chunk).split('"')
        self.depth += _depth(plain[self.inside :: 2])
        self.inside ^= len(plain) % 2 == 0
        self.depth -= not self.inside


def _effects(batches):
    """Of each split what it does from outside and from inside a string, and the first sign of a file."""
    held: dict[tuple, list] = {}
    for file, block, chunks in _blocks(batches):
        if (file, block) not in held:
            held[file, block] = [_Scan(), _Scan(0, True), chunks[0].lstrip("﻿ \t\r\n")[:1] if block == 0 else ""]
        for chunk in chunks:
            held[file, block][0].over(chunk)
            held[file, block][1].over(chunk)
    if held:
        cols = zip(*[(f, b, o.depth, o.inside, i.depth, i.inside, sign) for (f, b), (o, i, sign) in held.items()])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["file", "block", "d0", "s0", "d1", "s1", "sign"])


def _objects(states: dict[tuple[str, int], tuple[int, bool]], base: dict[str, int], key: str):
    """Objects at the depth of the array's values, or parts of them, and where the array under `key` opens and arrays at its depth close."""

    def run(batches):
        scan, file, block, n, text, mark = None, None, None, 0, [], ""
        out: list[tuple] = []

        def say(kind, value):
            nonlocal n
            out.append((file, block, n, kind, value))
            n += 1

        def leave():
            if text:
                say("part", ("m" if scan.carried else "b") + "".join(text))

        for f, b, chunks in _blocks(batches):
            if (f, b) not in states:
                continue  # a file that is not sound
            if (f, b) != (file, block):
                if scan is not None:
                    leave()
                file, block, n, text, mark = f, b, 0, [], ""
                scan = _Scan(*states[f, b])
                scan.carried = scan.depth > base[f]
            low = base[file]
            for chunk in chunks:
                depth, begin = scan.depth, _REST.match(chunk).end() if scan.inside else 0
                if scan.carried and "]" in chunk:
                    # what goes on here is an array among the values if a bracket closes it; then it is nobody's
                    for m in _TOKEN.finditer(chunk, begin):
                        depth += (m.group() in "{[") - (m.group() == "]")
                        if depth == low:
                            text, scan.carried, begin = [], False, m.end()
                            break
                start = 0
                if not text and not scan.carried:
                    # between values: what opens and closes around them is looked at sign by sign, up to the next object
                    start = None
                    for m in _TOKEN.finditer(chunk, begin):
                        sign = m.group()
                        if sign[0] == '"':
                            mark = sign if depth == low - 1 else mark
                        elif sign == "{" and depth == low:
                            start = m.start()
                            break
                        elif sign == "]":
                            depth -= 1
                            if depth == low - 1:
                                say("close", None)
                        else:
                            depth += 1
                            if sign == "[" and depth == low and (low == 1 or mark == f'"{key}"'):
                                say("open", None)
                scan.over(chunk)
                if start is None:
                    continue
                text.append(chunk[start:] + "}")
                if scan.depth == low and not scan.inside:
                    say("part", ("e" if scan.carried else "w") + "".join(text))
                    text, scan.carried = [], False
            if len(out) > 2000:
                yield _said(out)
                out = []
        if scan is not None:
            leave()
        if out:
            yield _said(out)

    return run


def _said(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["file", "block", "n", "kind", "value"])


def read_objects(spark: SparkSession, path: str, key: str = "leads") -> DataFrame:
    """(file, pos struct<block,n>, value): the objects of the array in each file, as JSON text, in the order of pos."""
    chunks = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    effects = chunks.mapInArrow(_effects, "file string, block long, d0 long, s0 boolean, d1 long, s1 boolean, sign string").collect()  # a row a split
    states, base, end = {}, {}, {}
    for r in sorted(effects, key=lambda r: (r["file"], r["block"])):
        depth, inside = end.get(r["file"], (0, False))
        states[r["file"], r["block"]] = depth, inside
        end[r["file"]] = (depth + (r["d1"] if inside else r["d0"]), r["s1"] if inside else r["s0"])
        if r["block"] == 0:
            base[r["file"]] = {"[": 1, "{": 2}.get(r["sign"], 0)
    # the last chunk may have had no brace, which was counted all the same
    sound = {f for f, (depth, inside) in end.items() if depth in (0, -1) and not inside and base.get(f)}
    states = {k: v for k, v in states.items() if k[0] in sound}
    said = chunks.mapInArrow(_objects(states, base, key), "file string, block long, n long, kind string, value string").withColumn("pos", F.struct("block", "n"))
    marks = said.where("kind <> 'part'").groupBy("file").agg(F.min(F.when(F.col("kind") == "open", F.col("pos"))).alias("open"), F.array_sort(F.collect_list(F.when(F.col("kind") == "close", F.col("pos")))).alias("closes"))
    marks = marks.where("open is not null").select("file", "open", F.get(F.filter("closes", lambda p: p > F.col("open")), 0).alias("close"))
    parts = said.where("kind = 'part'").join(marks, "file").where((F.col("pos") > F.col("open")) & (F.col("close").isNull() | (F.col("pos") < F.col("close"))))
    parts = parts.select("file", "pos", F.left("value", F.lit(1)).alias("how"), F.substring("value", 2, 1 << 30).alias("value"))
    whole = parts.where("how = 'w'").select("file", "pos", "value")
    # at most two parts a split: those of one object follow each other
    order = Window.partitionBy("file").orderBy("pos")
    begun = parts.where("how <> 'w'").withColumn("of", F.sum(F.when(F.col("how") == "b", 1).otherwise(0)).over(order))
    # parts of values that aren't objects follow one that has ended
    ended = F.sum(F.when(F.col("how") == "e", 1).otherwise(0)).over(Window.partitionBy("file", "of").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    cut = begun.where("of > 0").withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0")
    joined = cut.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p")).select("file", F.get("p", 0)["pos"].alias("pos"), F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    return whole.unionByName(joined)
