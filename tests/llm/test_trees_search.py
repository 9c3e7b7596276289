from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlake.llm.partition_search import balanced_partition, neighbour_graph, partition_search
from rosterlake.llm.reply_trees import escape, format_conversations, format_turns, parse_turns, reply_paths, unescape


@given(st.lists(st.tuples(st.text(max_size=8), st.text("[]<>\\/sINTRU \na", max_size=30))))
def test_format_reads_back(turns):
    f, mask = format_turns(turns)
    assert parse_turns(f) == turns
    assert [unescape(f[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_control_strings_cannot_stand_in_texts():
    for s in ("</s>", "<s>", "[TURN user]", "[/TURN]", "\\[/TURN]", "[INST]"):
        assert s not in escape(s * 2) and unescape(escape(s)) == s
    with pytest.raises(ValueError):
        parse_turns("<s>x</s>")


def test_paths_of_a_tree(spark):
    r = random.Random(1)
    parent = {0: None, **{i: r.randrange(i) for i in range(1, 60)}, **{i: i - 1 if i > 100 else None for i in range(100, 180)}, 300: 999, 400: 401, 401: 400, 402: 401}
    score = {i: None if i % 7 == 0 else r.randint(-5, 5) for i in parent}
    nodes = spark.createDataFrame([(i, p, score[i]) for i, p in parent.items()], "node long, parent long, score long")
    children = {p for p in parent.values()}
    paths = {}
    for leaf in (i for i in parent if i not in children and i != 402):
        path = [leaf]
        while (p := parent[path[-1]]) is not None and p in parent:
            path.append(p)
        paths[leaf] = path[::-1]
    for keep in (1, 3):
        got = {}
        for x in reply_paths(nodes, keep).collect():
            got.setdefault((x["root"], x["branch_rank"], x["leaf"]), {})[x["pos"]] = x["node"]
        want = {}
        for root in {p[0] for p in paths.values()}:
            branches = sorted((-sum(score[n] or 0 for n in p), leaf) for leaf, p in paths.items() if p[0] == root)[:keep]
            for k, (_, leaf) in enumerate(branches):
                want[root, k + 1, leaf] = dict(enumerate(paths[leaf]))
        assert got == want


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, None, None, "</s>"), (None, 0, "user", "x"), (1, 5, "user", "a"), (1, 5, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("leaf", F.lit(1))
    got = {r["conv"]: parse_turns(r["formatted"]) for r in format_conversations(df).collect()}
    assert got == {1: [("user", "a"), ("assistant", ""), ("assistant", "b"), ("user", "a"), ("user", "a")], 2: [("", "</s>")], None: [("user", "x")]}
    assert format_conversations(df.where("false")).count() == 0


def test_branches_by_score(spark):
    rows = [(1, 0, "user", "q", None, 0), (1, 1, "assistant", "bad", 0, 1), (1, 2, "assistant", "good", 0, 5), (1, 3, "user", "thanks", 2, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, parent_turn int, score int")
    out = {r["branch_rank"]: [t for _, t in parse_turns(r["formatted"])] for r in format_conversations(df, keep=2).collect()}
    assert out == {1: ["q", "good", "thanks"], 2: ["q", "bad"]}


def _exact(rows, keep=20):
    good = [(i, np.array(v, float)) for i, v in {i: v for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)}.items()]
    out = {}
    for q, a in good:
        if q % 20 == 0:
            out[q] = [(i, s) for s, i in sorted((-(a * b).sum(), i) for i, b in good if i != q)[:keep]]
    return out


def test_search_edges(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3), 0.5]) for i in range(90)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (220, [1.0, 2.0]), (None, [1.0] * 4), (5, rows[5][1]), (240, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1))
    got = {}
    for r in partition_search(df).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], -r["score"]))
    want = _exact(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert partition_search(df.where("false")).count() == 0
    assert partition_search(df.where("vec_id = 0")).count() == 0


def test_recall_with_partitions(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 16)) * 2
    x = centres[r.integers(0, 40, 4000)] + r.standard_normal((4000, 16)) * 0.4
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = partition_search(df, sample=1024).toPandas()
    hit = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20]) & set(got[got.query_id == q].vec_id))
    assert hit / (200 * 20) >= 0.9


def test_recall_on_the_tables(spark, sf):
    """The real vectors, in partitions from 500 rows on: recall beside brute force, and a full list for every query."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = partition_search(spark.read.parquet(f"{sf}/embeddings.parquet")).toPandas()
    hit = n = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        mine = got[got.query_id == ids[k]]
        assert len(mine) == min(20, len(x) - 1)
        hit += len(set(ids[np.argsort(-s, kind="stable")[:20]]) & set(mine.vec_id))
        n += 20
    assert hit / n >= 0.9


def test_partitions_are_balanced():
    x = np.random.default_rng(1).standard_normal((512, 8))
    label = balanced_partition(neighbour_graph(x, 10), 8)
    assert np.bincount(label).tolist() == [64] * 8


@pytest.mark.parametrize("spread", [0.1, 0.5, 1.5, 3.0])
def test_recall_on_vectors_of_unequal_length(spark, spread):
    """Inner products favour long vectors: many rows are nobody's neighbour, and recall holds."""
    r = np.random.default_rng(7)
    x = r.standard_normal((2000, 32)) * np.exp(spread * r.standard_normal((2000, 1)))
    got = partition_search(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).toPandas()
    hit = 0
    for q in range(0, 2000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and mine.score.is_monotonic_decreasing
        assert np.allclose(mine.score, (x[mine.vec_id] * x[q]).sum(1), rtol=1e-12)
        hit += len(set(np.argsort(-s, kind="stable")[:20]) & set(mine.vec_id))
    assert hit / 2000 >= 0.9


def test_components_at_the_ends_of_the_range(spark):
    r = np.random.default_rng(9)
    x = r.standard_normal((600, 8)) * 10.0 ** r.choice([-170, -3, 0, 3, 160], (600, 1))
    got = partition_search(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).toPandas()
    assert got.groupby("query_id").size().tolist() == [20] * 30
    with np.errstate(over="ignore", invalid="ignore"):
        hit = 0
        for q in range(0, 600, 20):
            s = (x * x[q]).sum(1)
            s[np.isnan(s)] = -np.inf
            s[q] = -np.inf
            mine = got[got.query_id == q].sort_values("rank")
            # values may tie at nothing or infinity: what counts is how good the answers are
            hit += (mine.score.to_numpy() >= np.sort(s)[::-1][:20]).sum()
    assert hit / 600 >= 0.9
