"""Objects of one JSON array, read in splits of any size."""

from __future__ import annotations

import json
import random

import pytest

from rosterlake import schemas
from rosterlake.sources import files
from rosterlake.sources.json_array import _Scan, read_objects


def value(r: random.Random, depth: int = 0):
    text = lambda: "".join(r.choice('ab{}[]",:\\é\n ') for _ in range(r.randrange(12)))
    kind = r.randrange(6 if depth < 3 else 3)
    if kind == 3:
        return {text(): value(r, depth + 1) for _ in range(r.randrange(4))}
    if kind == 4:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return [text(), r.randrange(99), None, None, None, {"leads": [{"x": text()}]}][kind]


@pytest.mark.parametrize("size, many", [("900", 120), ("60", 12), ("4m", 120)])
def test_objects_of_a_file_in_splits(spark, tmp_path, size, many):
    r = random.Random(3)
    rows = [{"n": i, "v": value(r), "w": value(r)} for i in range(many)] + [{"n": 120, "long": "{\"" * 60}, {}]
    mixed = rows + [7, [{"n": -1}], "x{}", None]
    r.shuffle(mixed)
    want = [x for x in mixed if isinstance(x, dict)]
    forms = {
        "bare.json": json.dumps(mixed), "wide.json": json.dumps(mixed, indent=2, ensure_ascii=False), "wrapped.json": json.dumps({"meta": [{"n": -2}], "at": "2026 } [", "leads": mixed, "more": {"leads": [{"n": -3}]}, "tail": [{"n": -4}]}),
        "open.json": '{"leads": [{"n": 1}, {"n": 2}', "not.json": "{not json", "empty.json": "[]", "none.json": '{"leads": []}', "other.json": '{"people": [{"n": 1}]}',
    }
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, body in forms.items():
            (tmp_path / name).write_text(body, encoding="utf-8")
            got = [json.loads(x["value"]) for x in read_objects(spark, str(tmp_path / name)).orderBy("pos").collect()]
            assert got == (want if name in ("bare.json", "wide.json", "wrapped.json") else []), name
            if name == "bare.json" and size != "4m":
                assert spark.read.option("lineSep", "}").text(str(tmp_path / name)).rdd.getNumPartitions() >= 8
    finally:
        for k, v in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before):
            spark.conf.set(k, v)


def test_state_is_that_of_a_sign_by_sign_scan():
    r = random.Random(5)
    for _ in range(300):
        text = json.dumps(value(r)) + "}"
        scan, depth, inside, skip = _Scan(), 0, False, False
        for chunk in text.split("}")[:-1]:
            scan.over(chunk)
        for c in text:
            if skip:
                skip = False
            elif inside:
                skip, inside = c == "\\", c != '"'
            else:
                inside = c == '"'
                depth += (c in "{[") - (c in "]}")
        assert (scan.depth, scan.inside) == (depth, inside)


def test_last_row_of_a_key_wins_across_splits(spark, tmp_path):
    rows = [{"name": f"P{i % 50}", "school_domain": "a.edu", "title": f"t{i}"} for i in range(400)]
    (tmp_path / "s.json").write_text(json.dumps({"updated_at": "x", "count": 400, "leads": rows}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r["name"]: r["title"] for r in files.read_store(spark, str(tmp_path / "s.json"), schemas.person()).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"P{k}": f"t{350 + k}" for k in range(50)}
