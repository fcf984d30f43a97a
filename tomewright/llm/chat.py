"""Chat formatting of reply trees.

Messages form trees by their parents. Iterative self-joins double the reach: after k joins every message knows its ancestor 2**k steps
up and the scores on the way. Leaves are ranked by the mean score of their paths; only the chosen paths are then enumerated, by the
same jumps, and each becomes one conversation: a text in the template below, with spans of characters for the loss mask. Each
jump is stored, so a thread of a thousand replies takes ten joins up and ten back, and no plan holds more than one of them.

Template: a turn is "### ", the role with an upper-case first letter, ": ", the text, " </turn>", a line end. Inside roles and texts every
backslash and the first character of every control string gets a backslash before it, which parsing takes off again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: What a text may not hold bare: a backslash, or a control string without its white space.
_CONTROL = regex.compile(r"\\|###|</turn>")
_ROLE_CONTROL = regex.compile(r"\\|###|</turn>|:")
_ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)
LEARNED = ("assistant",)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learned: tuple[str, ...] = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and the spans [start, end) of characters that count for the loss: the learned roles' texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + MIDDLE
        body = escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


_TURN = regex.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", regex.DOTALL)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises ValueError where the text isn't in the template."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None or not found[2].endswith(" "):
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2][:-1])))
        at = found.end()
    return turns


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of messages (tree, node, parent, role, text, score): tree, leaf, depth (0 at the root), role, text.

    A node without a parent, or whose parent isn't there, is a root. Of each tree the branches paths of the highest mean score
    are chosen (None: all), ties by the smaller leaf; only their messages are enumerated. Null scores count as 0; a null tree is a tree, a
    null node isn't a message. Of rows with the same tree and node the least (parent, role, text, score) counts. Messages on or
    below a cycle of parents have no root and lie on no path. A path is one value further on, however long it is."""
    tree = F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit(""))
    given = messages.where("node is not null").select(tree.alias("t"), "tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    one = F.min(F.struct("parent", "role", "text", "score", "tree")).alias("m")
    rows = stash(given.groupBy("t", "node").agg(one).select("t", "m.tree", "node", "m.parent", "m.role", "m.text", "m.score"), "messages")
    nodes = rows.select("t", "node")
    known = rows.where("parent is not null").select("t", "node", F.col("parent").alias("up")).join(nodes.select("t", F.col("node").alias("up")), ["t", "up"]).select("t", "node", "up")
    known = stash(known, "known")
    # Where a node gets by 2**k steps up, and the sum and number of the scores on the way; up is null once the root is passed.
    # Nodes that are past it are settled: later jumps read them, but carry only the open ones on.
    state = stash(rows.select("t", "node", F.col("score").alias("sum"), F.lit(1).cast("long").alias("length")).join(known, ["t", "node"], "left"), "reach")
    open_nodes, settled, steps = state.where("up is not null"), state.where("up is null"), [known]
    most = rows.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    while (1 << (len(steps) - 1)) < most and not steps[-1].isEmpty():
        above = open_nodes.unionByName(settled).select("t", F.col("node").alias("up"), F.col("up").alias("top"), F.col("sum").alias("more"), F.col("length").alias("further"))
        state = stash(open_nodes.join(above, ["t", "up"]).select("t", "node", F.col("top").alias("up"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("length") + F.col("further")).alias("length")), "reach")
        open_nodes, settled = state.where("up is not null"), settled.unionByName(state.where("up is null").select(*settled.columns))
        steps.append(open_nodes.select("t", "node", "up"))
    # Only a cycle has nodes with an ancestor left after as many steps as the tree has messages.
    leaves = settled.join(known.select("t", F.col("up").alias("node")).distinct(), ["t", "node"], "left_anti")
    ranked = leaves.select("t", F.col("node").alias("leaf"), (F.col("sum") / F.col("length")).alias("score"), "length")
    if branches is not None:
        # First within parts of a tree, so that no task ranks a whole hot tree.
        best = [F.desc("score"), F.asc("leaf")]
        ranked = ranked.withColumn("part", F.pmod(F.xxhash64("leaf"), F.lit(64)))
        for by in (["t", "part"], ["t"]):
            ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= branches)
    chosen = stash(ranked.select("t", "leaf", "length"), "chosen")
    reached = chosen.select("t", "leaf", F.col("leaf").alias("node"), (F.col("length") - 1).cast("int").alias("depth"))
    for k in range(len(steps) - 1, -1, -1):
        further = reached.join(steps[k], ["t", "node"]).select("t", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        reached = reached.unionByName(stash(further, "reached"))  # else each jump's plan would hold that of the last one twice
    return reached.join(rows.drop("score", "parent"), ["t", "node"]).select("tree", "leaf", "depth", "role", "text")


def format_paths(path_rows: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """A row per path: tree, leaf, formatted, loss_spans (characters [start, end))."""
    turns = path_rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns], learned) for turns in batch.column(2).to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in made], pa.string()), spans], names=["tree", "leaf", "formatted", "loss_spans"])

    kinds = dict(turns.dtypes)
    return turns.mapInArrow(run, f"tree {kinds['tree']}, leaf {kinds['leaf']}, formatted string, loss_spans array<struct<start:long,end:long>>")


def threads(df: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """A table of linear conversations as messages of reply trees: each turn replies to the one before. Equal turns are put in order
    by role and text, so repeated rows are turns of their own."""
    place = F.row_number().over(Window.partitionBy(tree).orderBy(F.asc_nulls_first(order), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    rows = df.select(F.col(tree).alias("tree"), place.alias("node"), "role", "text")
    return rows.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of formatted conversations, parsed again: tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kinds = dict(formatted.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(said.encode("utf-8")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8")).hexdigest(), len(text)))
            kinds_out = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds_out)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "leaf", "formatted", "loss_spans").mapInArrow(run, f"tree {kinds['tree']}, leaf {kinds['leaf']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
