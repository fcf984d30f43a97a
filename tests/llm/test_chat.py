import hashlib
import random

import pytest

from tomewright.llm import chat
from tomewright.llm.queries import HARD_TEXT


def test_template_is_reversible():
    draw = random.Random(4)
    bits = ["\\", "###", "### ", "</turn>", " </turn>\n", ": ", "a", " ", "\n", "<", "é🙂", "assistant", "#", HARD_TEXT]
    for _ in range(500):
        turns = [("".join(draw.choices(bits, k=draw.randint(0, 3))), "".join(draw.choices(bits, k=draw.randint(0, 8)))) for _ in range(draw.randint(0, 5))]
        turns += [("assistant", "".join(draw.choices(bits, k=4)))]
        formatted, spans = chat.format_turns(turns)
        assert chat.parse_turns(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        chat.parse_turns("### user: no end")


def test_linear_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 3, "user", "x"), (None, None, "user", ""), (-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}" * (i % 5)) for i in range(150)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.paths(chat.threads(df)))).collect()}
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def brute(messages, branches):
    by = {}
    for m in messages:
        by.setdefault(m[0], {})[m[1]] = m
    out = []
    for tree, nodes in by.items():
        parents = {m[2] for m in nodes.values()}
        found = []
        for node in nodes:
            if node in parents:
                continue
            path, at = [], node
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][2]
            if at in path:
                continue
            scores = [nodes[n][5] or 0.0 for n in path]
            found.append((-sum(scores) / len(scores), node, path[::-1]))
        for _, leaf, path in sorted(found)[:branches]:
            out += [(tree, leaf, d, nodes[n][4]) for d, n in enumerate(path)]
    return sorted(out, key=str)


@pytest.mark.parametrize("branches", [1, 3, None])
def test_trees(spark, branches):
    draw = random.Random(8)
    messages = []
    for tree in [1, 2, 3, None]:
        for node in range(40):
            parent = draw.choice([None, 900, *range(node)]) if node else None
            messages.append((tree, node, parent, "user", f"m{tree}-{node}", draw.choice([None, 0.0, 1.0, 2.0])))
    messages += [(5, 1, 2, "user", "c1", 1.0), (5, 2, 1, "user", "c2", 1.0), (5, 3, 1, "user", "c3", 1.0), (6, 1, 1, "user", "self", 1.0)]
    df = spark.createDataFrame(messages, "tree long, node long, parent long, role string, text string, score double")
    got = chat.paths(df, branches)
    assert sorted((tuple(r) for r in got.select("tree", "leaf", "depth", "text").collect()), key=str) == brute(messages, branches)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_paths(chat.paths(chat.threads(df)))).collect() == []


def test_deep_tree_stores_the_chosen_paths_only(spark, monkeypatch):
    """A trunk with a leaf on every message: what is stored grows with messages times the logarithm of the depth, not with its square."""
    depth = 200
    messages = [(1, i, i - 1 if i else None, "user", f"m{i}", float(i)) for i in range(depth)] + [(1, 1000 + i, i, "user", f"l{i}", 0.0) for i in range(depth)]
    df = spark.createDataFrame(messages, "tree long, node long, parent long, role string, text string, score double")
    stored, stash = [], chat.stash

    def counting(rows, label):
        out = stash(rows, label)
        stored.append(out.count())
        return out

    monkeypatch.setattr(chat, "stash", counting)
    got = chat.paths(df, 1)
    assert sorted(tuple(r) for r in got.select("tree", "leaf", "depth", "text").collect()) == sorted(brute(messages, 1))
    assert sum(stored) <= 2 * depth * 18


def test_deep_threads_keep_plans_small(spark):
    """A thread of a thousand messages: the last plan has the join with the texts and no jumps, and every message is there."""
    depth = 1000
    df = spark.range(depth).selectExpr("1L AS tree", "id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent", "'user' AS role", "concat('m', id) AS text", "0.0 AS score")
    got = chat.paths(df)
    assert got._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert [(r["depth"], r["text"]) for r in got.orderBy("depth").collect()] == [(i, f"m{i}") for i in range(depth)]


def test_repeated_nodes_and_long_texts(spark):
    long = "word " * 400_000
    messages = [(1, 1, None, "user", "root", 0.0)] * 3 + [(1, 1, None, "user", "zzz", 0.0), (1, 2, 1, "assistant", long, 0.0), (1, None, 1, "user", "no node", 0.0)]
    df = spark.createDataFrame(messages, "tree long, node long, parent long, role string, text string, score double")
    rows = chat.paths(df, None).collect()
    assert [(r["depth"], r["text"]) for r in sorted(rows, key=lambda r: r["depth"])] == [(0, "root"), (1, long)]
    (back,) = chat.read_back(chat.format_paths(chat.paths(df, None))).collect()
    assert back["n_turns"] == 2 and back["loss_chars"] == len(long)
