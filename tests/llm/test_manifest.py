from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rosterlake.llm.merkle import coordinates, folded, hexed, leaf_of, manifest, proof_digest
from rosterlake.llm.order import placed
from rosterlake.llm.queries import op11_merkle_proofs
from tests.llm.brute import sha

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def leaf(row: dict, add: int = 0) -> str:
    cells = [row[c] if c != "n_chars" or row[c] is None else row[c] + add for c in COLUMNS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in cells))


def climb(level: list[str], i: int, fanout: int) -> tuple[str, list[tuple[list[str], list[str]]]]:
    """Root of a level, and the siblings before and after the way from place i, level by level."""
    way = []
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        run, at = runs[i // fanout], i % fanout
        way.append((run[:at], run[at + 1 :]))
        level, i = [sha("".join(r)) for r in runs], i // fanout
    return level[0], way


def proofs(rows: list[dict], fanout: int = 2):
    """By definition: sorted (doc_id, leaf, subroot, root, proof hash, folded root, verified)."""
    byte = lambda v: (v is not None, (v or "").encode())
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    langs = sorted(groups, key=byte)
    leaves = {g: [leaf(r) for r in groups[g]] for g in langs}
    subs = [climb(leaves[g], 0, fanout)[0] for g in langs]
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            sub, low = climb(leaves[g], i, fanout)
            root, high = climb(subs, k, fanout)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            up = leaf(r, 1) if hit else leaves[g][i]
            for before, after in low + high:
                up = sha("".join(before) + up + "".join(after))
            out.append((r["doc_id"], leaves[g][i], sub, root, sha("".join("".join(a + b) for a, b in low + high)), up, up == root))
    return sorted(out, key=str)


def odd_rows() -> list[dict]:
    r = random.Random(4)
    rows = [{"doc_id": i, "text": "word é " * r.randrange(6), "lang": r.choice(["en"] * 6 + ["de", "fr", None, "", "é"]), "source": r.choice(["a", None]), "n_chars": r.choice([None, 3, 70])} for i in range(90)]
    rows += [dict(rows[3])] * 5  # repeated rows
    rows += [{"doc_id": 7, "text": None, "lang": "en", "source": None, "n_chars": None}, {"doc_id": None, "text": "x", "lang": "en", "source": "s", "n_chars": 1}, {"doc_id": 500, "text": "lone", "lang": "zz", "source": "s", "n_chars": 4}]
    return rows + [{"doc_id": 501, "text": "é" * 300_000, "lang": "de", "source": "s", "n_chars": 300_000}]


def test_query_equals_definition(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_proofs(spark, str(tmp_path))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == proofs(rows)


@pytest.mark.parametrize("fanout", [3, 5])
def test_other_fanouts_and_clashing_names(spark, fanout):
    rows = [r for r in odd_rows() if r["doc_id"] is not None][:40]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], KIND)
    df = df.select("*", F.lit(1).alias("_place"), F.lit("x").alias("TEXT"), F.lit(2).alias("tree"))
    made = manifest(df, COLUMNS, fanout=fanout, carry={"doc_id": F.col("doc_id")})
    got = made.proofs().select("doc_id", hexed("digest"), "subroot", proof_digest(F.col("path"), F.col("top_path")), folded(hexed(F.col("digest")), fanout))
    want = [(d, le, sub, proof, root) for d, le, sub, root, proof, _, _ in proofs(rows, fanout)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert made.root == want[0][-1]


def test_empty_table_has_no_root(spark):
    made = manifest(spark.createDataFrame([], KIND), COLUMNS)
    assert made.root is None and made.proofs().count() == 0 and made.nodes.count() == 0


def test_coordinates_follow_from_place_and_size(spark):
    at = lambda p, n, f: spark.range(1).select(coordinates(F.lit(p), F.lit(n), f)).first()[0]
    assert [tuple(c) for c in at(4, 5, 2)] == [(2, 0)]  # lone on two levels, then one sibling
    assert [tuple(c) for c in at(0, 1, 2)] == []
    assert [tuple(c) for c in at(1, 4, 3)] == [(0, 0), (0, 2), (1, 1)]


def test_leaf_is_the_stated_bytes(spark):
    got = spark.createDataFrame([(12, None, "é")], "a long, b string, c string").select(hexed(leaf_of([F.col("a"), F.col("b"), F.col("c")]))).first()[0]
    assert got == hashlib.sha256("2:12-2:é".encode()).hexdigest()


def test_places_of_a_hot_group_are_dealt(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g"), (F.col("id") % 2).alias("k"), "id")
    got = placed(df, ["g"], [F.col("k")]).collect()
    for g in ("hot", None):
        mine = sorted((r["_place"], r["k"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine)
        assert {r["_rows"] for r in got if r["g"] == g} == {len(mine)}
