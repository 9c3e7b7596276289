"""Indexed search beside the scan, and paging beside offsets."""

from __future__ import annotations

import random

import pytest

from rosterlake.operators import queries as Q
from rosterlake.operators.search import SearchIndex


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcÉé -") for _ in range(r.randrange(0, 9)))
    data = [(f"k{i:04}", r.choice([None, "", word(), word().upper()]), [word() for _ in range(r.randrange(3))], r.choice([None, i % 7])) for i in range(400)]
    data += [("only", "Needle in a haystack", ["x"], 1), ("twin", "needle", [], 2)]
    return spark.createDataFrame(data, "key string, name string, tags array<string>, n int").cache()


def test_index_gives_what_the_scan_gives(rows, tmp_path):
    index = SearchIndex.build(rows, f"{tmp_path}/i", buckets=8)
    for needle in ("needle", "NEEDLE IN", "abc", "é", "É é", "b", "; ", "k00", "k0123", "zzz", "haystack!", ""):
        want = sorted(map(tuple, rows.where(Q.record_search(rows, needle)).collect()), key=str) if needle else sorted(map(tuple, rows.collect()), key=str)
        assert sorted(map(tuple, index.search(needle).collect()), key=str) == want, needle


def test_selective_needle_reads_less(spark, rows, tmp_path):
    """Of eight folders of rows and of postings the plan names those that the needle's grams and hits fall into."""
    import re

    SearchIndex.build(rows, f"{tmp_path}/i", buckets=8)
    few = SearchIndex(spark, f"{tmp_path}/i").search("haystack")
    plan = few._jdf.queryExecution().executedPlan().toString()
    named = [set(re.findall(r"\d+", x)) for x in re.findall(r"PartitionFilters: \[[^\]]*_bucket#\d+ (?:IN \(|= )([\d, ]*)", plan)]
    assert few.count() == 1 and len(named) == 2 and all(0 < len(x) <= 4 for x in named) and min(map(len, named)) == 1


def test_pages_by_cursor_and_by_number(rows):
    for sort in ("name", "tags", "n", "key"):
        for down in (False, True):
            after, seen = None, []
            for _ in range(5):
                page, cursor = Q.page_after(rows, sort, after, descending=down, limit=97)
                got = [r["key"] for r in page.collect()]
                after = cursor()
                seen.append(got)
            want = [[r["key"] for r in Q.page(rows, sort, descending=down, offset=97 * i, limit=97).collect()] for i in range(5)]
            assert seen == want
    for number in (0, 3, 4, 9):
        assert [r["key"] for r in Q.page_at(rows, "name", number, descending=True, limit=97).collect()] == [r["key"] for r in Q.page(rows, "name", descending=True, offset=97 * number, limit=97).collect()]
    page, cursor = Q.page_after(rows, "name", (1, None, "zzz"))
    assert page.count() == 0 and cursor() is None
    with pytest.raises(ValueError):
        Q.page_after(rows, "nothing")
