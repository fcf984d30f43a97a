"""Product codes against a plain Lloyd iteration over all parts and entries."""

import hashlib
import math

import numpy as np
import pytest

from tomewright.llm import vector_codes as vc


def brute(rows, parts, entries, rounds):
    """rows: (key, vector, label), usable ones only. Codes, errors and codebooks by measuring everything, in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[min(max(math.floor(256 * x), -vc.MOST), vc.MOST) for x in v] for _, v, _ in rows]
    width = -(-len(whole[0]) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    nearest = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            won = [nearest(c[p], books[p])[1] for c in cut]
            for i in range(len(books[p])):
                own = [c[p] for c, w in zip(cut, won, strict=True) if w == i]
                if own:
                    books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for (key, _, label), c in zip(rows, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((key, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    by_label = {}
    for _, label, _, error in out:
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r), by_label[r[1]]) for r in out), digest


@pytest.mark.parametrize("n, spread, d", [(1, 5, 3), (7, 2, 1), (300, 2, 2), (900, 40, 4), (1000, 3, 3)])
def test_filtering_gives_the_nearest_entries(n, spread, d):
    """Small integers, so that ties are many and boxes have zero width."""
    random = np.random.default_rng(n)
    points, entries = random.integers(-spread, spread + 1, (n, d)), random.integers(-spread, spread + 1, (min(n, 20), d))
    tree = vc.build_tree(points)
    won, counts, sums, _ = vc.filtered(tree, entries)
    apart = ((points[tree.order][:, None, :] - entries[None]) ** 2).sum(2)
    assert won.tolist() == apart.argmin(1).tolist() and sorted(tree.order.tolist()) == list(range(n))
    assert counts.tolist() == np.bincount(won, minlength=len(entries)).tolist()
    for i in range(len(entries)):
        assert sums[i].tolist() == points[tree.order][won == i].sum(0).tolist()
    again = vc.read_trees(tree.points.astype("<i4").tobytes(), tree.order.astype("<i4").tobytes(), 1, d)[0]
    assert all((a == b).all() for x, y in ((tree.low, again.low), (tree.high, again.high), (tree.total, again.total)) for a, b in zip(x, y, strict=True))


def test_subtrees_are_assigned_at_once():
    random = np.random.default_rng(3)
    entries = np.array([[0, 0], [1000, 0], [0, 1000], [5000, 5000]])
    points = np.concatenate([c + random.integers(-50, 51, (500, 2)) for c in entries])
    assert vc.filtered(vc.build_tree(points), entries)[3] == 0


ODD = "vec_id long, vector array<double>, label int, code string, rows int"


def test_all_cases(spark):
    """Ties, repeated rows, null keys and labels, unusable vectors, a length that isn't a multiple of the parts, clashing column names."""
    random = np.random.default_rng(5)
    good = [(i, [round(float(x), 2) for x in random.normal(0, 0.05, 7)], [None, 0, 1][i % 3]) for i in range(4, 90)]
    good += [good[3], good[3], (None, good[5][1], None), (None, good[6][1], 1), (200, [1e12] * 7, 5), (201, [-1e12] * 7, 5), (202, [0.0] * 7, None)]
    bad = [(0, None, 1), (1, [], 1), (2, [1.0, None, *[1.0] * 5], 1), (3, [float("nan")] * 7, 1), (300, [1.0] * 8, 1), (301, [float("inf")] + [0.0] * 6, None), (302, [float("-inf")] + [0.0] * 6, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], ODD)
    coded, books = vc.product_codes(df, parts=3, entries=5)
    want, digest = brute(good, 3, 5, 2)
    assert sorted((str((r["vec_id"], r["label"], r["code"], r["error"])), r["label_error"]) for r in coded.collect()) == want
    assert books.digest == digest and coded.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_several_blocks(spark):
    random = np.random.default_rng(6)
    rows = [(i, [float(x) for x in random.normal(0, 1, 4)], i % 4) for i in range(vc.BLOCK_ROWS + 500)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>, label int").coalesce(1)
    coded, books = vc.product_codes(df, parts=2, entries=9, rounds=1)
    want, digest = brute([(r["vec_id"], list(r["vector"]), r["label"]) for r in df.collect()], 2, 9, 1)
    assert sorted((str((r["vec_id"], r["label"], r["code"], r["error"])), r["label_error"]) for r in coded.collect()) == want and books.digest == digest


def test_nothing_usable(spark):
    coded, books = vc.product_codes(spark.createDataFrame([(1, None, 2)], "vec_id long, vector array<float>, label int"))
    assert coded.collect() == [] and books is None and coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    with pytest.raises(ValueError):
        vc.product_codes(coded, entries=257)
