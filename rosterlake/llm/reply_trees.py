"""Chat formatting of reply trees.

reply_paths: nodes with a parent, by iterated self-joins. Round k joins "2**k steps up" with itself, so a tree of depth d
takes log2(d) rounds; the leaves then collect their ancestors by the same tables, highest first. A root is a node whose
parent is null or absent; nodes on a cycle have no root and are in no path. A branch's score is the sum of its nodes'
scores (null: 0); branches of a root are ranked by score, ties to the smaller leaf.

format_paths: each chosen path as one conversation:

    <s>[TURN role]\\ntext[/TURN]\\n ... </s>

Roles are percent-encoded. In texts a backslash is put behind every `\\`, `<` and `[`, so no control string can stand in
a text, whatever it says, and reading back takes the backslashes away. The loss mask is the code point ranges of the
assistant texts in the formatted string.

Null text is empty, a null role an empty role; repeated rows and equal turns are turns of their own, ordered by turn (null
first), role and text; rows with a null conversation id form one conversation; an empty table gives an empty result. A very long
text takes a few times its size. Columns besides those named are left out, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.tables import materialise

_UNESCAPE = re.compile(r"([\\<\[])\\")
_TURN = re.compile(r"\[TURN ([^\]]*)\]\n((?:[^\\<\[]++|[\\<\[]\\)*+)\[/TURN\]\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    out, at, mask = ["<s>"], 3, []
    for role, text in turns:
        head, body = f"[TURN {quote(role, safe='')}]\n", escape(text)
        if role == learn:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "[/TURN]\n"]
        at += len(head) + len(body) + 8
    return "".join([*out, "</s>"]), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; ValueError if it isn't one."""
    if not (formatted.startswith("<s>") and formatted.endswith("</s>")):
        raise ValueError("not a formatted conversation")
    at, turns = 3, []
    while at < len(formatted) - 4:
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unquote(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def reply_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """nodes(node, parent, score; node unique) -> (root, leaf, node, pos from 0, branch_score, branch_rank <= keep)."""
    base = nodes.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = base.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    base = materialise(base.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"), "nodes")
    up = [base.where("parent is not null").select("node", F.col("parent").alias("anc"))]
    size = base.count()
    rootless = None
    while up[-1].limit(1).count():
        if 1 << (len(up) - 1) >= size:
            rootless = up[-1].select("node").distinct()  # an ancestor as far up as there are nodes: below a cycle
            break
        far = up[-1]
        step = far.alias("a").join(far.alias("b"), F.col("a.anc") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.anc").alias("anc"))
        up.append(materialise(step, "up"))
    up.pop()
    leaves = base.select("node").join(base.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    if rootless is not None:
        leaves = leaves.join(rootless, "node", "left_anti")
    reach = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    for k in reversed(range(len(up))):
        more = reach.join(up[k], "node").select("leaf", F.col("anc").alias("node"), (F.col("dist") + F.lit(1 << k)).alias("dist"))
        reach = materialise(reach.unionByName(more), "reach")
    scored = reach.join(base, "node")
    branch = scored.groupBy("leaf").agg(F.sum("score").alias("branch_score"), F.max("dist").alias("depth"), F.max(F.when(F.col("parent").isNull(), F.col("node"))).alias("root"))
    branch = branch.where("root is not null")
    if keep == 1:
        best = branch.groupBy("root").agg(F.max("branch_score").alias("branch_score"))
        best = branch.join(best, ["root", "branch_score"]).groupBy("root", "branch_score").agg(F.min(F.struct("leaf", "depth")).alias("l"))
        chosen = best.select("root", "l.leaf", "l.depth", "branch_score", F.lit(1).alias("branch_rank"))
    else:
        order = Window.partitionBy("root").orderBy(F.desc("branch_score"), "leaf")
        chosen = branch.withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= keep)
    return reach.join(chosen, "leaf").select("root", "leaf", "node", (F.col("depth") - F.col("dist")).alias("pos"), "branch_score", "branch_rank")


def _format(learn: str):
    def run(batches):
        for rows in batches:
            text, mask = [], []
            for turns in rows.column("turns").to_pylist():
                turns.sort(key=lambda t: t["pos"])
                f, m = format_turns([(t["role"] or "", t["text"] or "") for t in turns], learn)
                text.append(f)
                mask.append([{"start": a, "end": b} for a, b in m])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rows.column("conv"), rows.column("branch_rank"), pa.array(text, pa.string()), pa.array(mask, kind)], names=["conv", "branch_rank", "formatted", "loss"])

    return run


def format_conversations(rows: DataFrame, keep: int = 1, learn: str = "assistant") -> DataFrame:
    """rows(conv_id, turn, role, text[, parent_turn, score]) -> (conv, branch_rank, formatted, loss). Without parent_turn
    each turn replies to the one before it; with it, to the last row of that turn before it."""
    has_parent, has_score = "parent_turn" in rows.columns, "score" in rows.columns
    cols = [F.col("conv_id").alias("conv"), "turn", "role", "text", (F.col("parent_turn") if has_parent else F.lit(None).cast("int")).alias("parent_turn"), (F.col("score") if has_score else F.lit(0.0)).cast("double").alias("score")]
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    seq = materialise(rows.select(*cols).withColumn("seq", F.row_number().over(order).cast("long")), "turns")
    node = lambda s: F.struct(F.col("conv").alias("c"), s.alias("s"))
    if has_parent:
        last = seq.groupBy("conv", "turn").agg(F.max("seq").alias("p")).select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "p")
        nodes = seq.join(last, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("parent_turn") == F.col("_t")), "left").select(node(F.col("seq")).alias("node"), F.when(F.col("p").isNotNull() & (F.col("p") != F.col("seq")), node(F.col("p"))).alias("parent"), "score")
    else:
        nodes = seq.select(node(F.col("seq")).alias("node"), F.when(F.col("seq") > 1, node(F.col("seq") - 1)).alias("parent"), "score")
    paths = reply_paths(nodes, keep)
    texts = paths.join(seq.select(node(F.col("seq")).alias("node"), "conv", "role", "text"), "node")
    per = texts.groupBy("leaf").agg(F.first("conv").alias("conv"), F.first("branch_rank").alias("branch_rank"), F.collect_list(F.struct("pos", "role", "text")).alias("turns"))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    return per.select("conv", "branch_rank", "turns").mapInArrow(_format(learn), f"conv {conv_type}, branch_rank int, formatted string, loss array<struct<start:bigint,end:bigint>>")


def read_back(batches):
    """formatted, loss -> digests of what the formatted string says."""
    for rows in batches:
        out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for f, loss in zip(rows.column("formatted").to_pylist(), rows.column("loss").to_pylist()):
            turns = parse_turns(f)
            learned = "".join(unescape(f[m["start"] : m["end"]]) for m in loss)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            for k, v in zip(out, (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(f))):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([rows.column("conv"), *[pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in out.items()]], names=["conv_id", *out])
