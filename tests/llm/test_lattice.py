from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import lattice_dedup
from rosterlake.llm.lattice_dedup import NEXT, Lattice, decode, lattice_links, plan, unit_rows


def links(rows, least=0.95):
    """By definition: sorted (id, links, least id reachable)."""
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(unit_rows(np.array([v], float))[0] if ok else None)
    near = [[j for j, w in enumerate(unit) if j != i and u is not None and w is not None and len(u) == len(w) and u @ w >= least] for i, u in enumerate(unit)]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(near[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "_links", "_component").collect()), key=str)


def around(rng, centre, n, angle):
    z = rng.standard_normal((n, len(centre)))
    z -= (z @ centre)[:, None] * centre
    return np.cos(angle) * centre + np.sin(angle) * z / np.linalg.norm(z, axis=1, keepdims=True)


def test_decoding_gives_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.uniform(-3, 3, (400, 8))
    p = decode(x)
    assert ((p.sum(1) % 2) == 0).all() and ((2 * p) % 1 == 0).all() and all(len(set(np.mod(r, 1))) == 1 for r in p)
    own = ((x - p) ** 2).sum(1)
    assert len(NEXT) == 240 and all((((x - p - v) ** 2).sum(1) >= own - 1e-12).all() for v in NEXT) and own.max() <= 1


def test_planned_tables_miss_hardly_any_pair():
    rng = np.random.default_rng(1)
    for n in (1000, 10**6, 10**8):
        scale, tables = plan(n, 0.95)
        x = unit_rows(rng.standard_normal((2000, 48)))
        y = np.array([around(rng, v, 1, np.arccos(0.95))[0] for v in x])
        lattice = Lattice(48, scale, tables, 4)
        a, b = lattice.cells(x), lattice.cells(y)
        assert lattice_dedup._meet(a, b).any(1).all()
    assert plan(10**8, 0.95)[0] > plan(1000, 0.95)[0]


def odd_rows():
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((60, 12)).tolist()
    centre = unit_rows(rng.standard_normal((1, 12)))[0]
    rows += (5 * around(rng, centre, 40, 0.12)).tolist() + around(rng, centre, 40, 0.25).tolist()
    rows += [rows[0]] * 9 + [[-x for x in rows[0]], [1e160 * x for x in rows[0]], [1e-170 * x for x in rows[0]]]
    rows += [None, [], [0.0] * 12, [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1.0] * 5, [1.0] * 5, [-0.0] * 12]
    return [(int(i), v) for i, v in enumerate(rows)] + [(3, rows[3]), (None, rows[1]), (None, None)]


def test_links_equal_definition(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("c"), F.lit(2).alias("x"), F.lit(3).alias("_links"), F.lit(4).alias("VEC_ID"))
    assert sorted(map(tuple, lattice_links(df).toDF("vec_id", "c", "x", "other", "_links", "_component").select("vec_id", "_links", "_component").collect()), key=str) == links(rows)


@pytest.mark.parametrize("block", [8, 64])
def test_dense_groups_in_balls_and_blocks(spark, monkeypatch, block):
    """Cells far over a block, with one ball, two, or none in them, give the counts that brute force gives."""
    for name, value in (("DENSE", 16), ("BLOCK", block), ("LEAST_BALL", 8)):
        monkeypatch.setattr(lattice_dedup, name, value)
    rng = np.random.default_rng(3)
    a = unit_rows(rng.standard_normal((1, 16)))[0]
    b = around(rng, a, 1, 0.22)[0]
    groups = [around(rng, a, 90, 0.05), around(rng, b, 50, 0.05), around(rng, a, 60, 0.3), rng.standard_normal((80, 16))]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate(groups))]
    rows += [(1000 + i, rows[0][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(lattice_links(df))
    assert got == links(rows)
    assert max(n for _, n, _ in got) > 100


def test_tasks_give_counts_not_pairs():
    rng = np.random.default_rng(5)
    x = around(rng, unit_rows(rng.standard_normal((1, 16)))[0], 300, 0.1)
    lattice = Lattice(16, 0.6, 3, 4)
    cells = lattice.cells(x)
    import pyarrow as pa

    rows = [(int(cells[i, 0, k]), i, k == 0) for i in range(300) for k in range(5)]
    rows.sort()
    cell, c, own = map(list, zip(*rows))
    n = len(rows)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(cell), pa.array([0] * n, pa.int32()), pa.array([0] * n), pa.array([2] * n, pa.int32()), pa.array(own), pa.array(c), pa.array([1] * n), pa.array([-1] * n), pa.array([x[i].tobytes() for i in c])],
        names=["cell", "t", "task", "side", "own", "c", "copies", "ball", "x"],
    )
    out = list(lattice_dedup._compare("<f8", 0.95, 0.6, 3, 4)(iter(batch.slice(i, 97) for i in range(0, n, 97))))
    met = sum(sum(o.column("n").to_pylist()) for o in out) // 2
    want = sum((cells[i, 0] == cells[j, 0, 0]).any() or (cells[j, 0] == cells[i, 0, 0]).any() for i, j in itertools.combinations(range(300), 2) if x[i] @ x[j] >= 0.95)
    assert met == want > 5000 and sum(o.num_rows for o in out) <= n


def test_empty_table(spark):
    assert lattice_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
