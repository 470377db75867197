"""The Merkle manifest against one built in plain Python, the negatives against all pairs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsift.llm import manifest as M
from tarnsift.llm import negatives as N

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """(root, [siblings of each leaf as (left, right) by level])."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for w, i in zip(ways, at):
            run = i - i % fanout
            w.append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
        at = [i // fanout for i in at]
        level = [H("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], ways


def brute(rows, fanout):
    """{(doc_id, leaf): (subroot, root, proof, folded, verified)} of (doc_id, lang, text)."""
    groups = {}
    for d, lang, text in rows:
        groups.setdefault(lang, []).append((leaf(d, lang, text), d, lang, text))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[1] is None, r[1] or 0, r[0]))
        trees[g] = climb([r[0] for r in groups[g]], fanout)
    root, above = climb([trees[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, above):
        for (own, d, lang, text), way in zip(groups[g], trees[g][1]):
            node = leaf(d, lang, f"{text}!") if d is not None and zlib.crc32(str(d).encode()) % 7 == 0 else own
            for left, right in [*way, *up]:
                node = H(left + node + right)
            out.append((d, own, trees[g][0], root, H("".join(a + b for a, b in [*way, *up])), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout,partition", [(2, 4), (3, 9), (2, 4096)])
def test_manifest_equals_plain_trees(spark, fanout, partition):
    draw = random.Random(5)
    sizes = {None: 1, "de": 75, "en": 16, "é": 2, "x" * 40: 33, "": 9}
    rows = [(i * 10 + draw.randint(0, 9), g, draw.choice(["", "text", None, "zwölf"])) for g, n in sizes.items() for i in range(n)]
    rows += [rows[3], rows[3], (None, "de", "no id"), (-4, "en", "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(7)
    made = M.verified(df, ["doc_id", "lang", "text"], "lang", fanout, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, [F.col("doc_id"), F.col("lang"), F.concat(F.coalesce("text", F.lit("None")), F.lit("!"))], partition)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in made.collect()), key=repr) == brute(rows, fanout)


def test_manifest_of_nothing_one_and_names_that_clash(spark):
    docs = spark.createDataFrame([(7, "de", "t", 1, "p")], "doc_id long, lang string, text string, part int, g string")
    assert M.verified(docs.limit(0), ["doc_id"], "lang").count() == 0
    (row,) = M.verified(docs, ["doc_id", "lang", "text"], "lang").collect()
    assert row["root"] == row["subroot"] == row["leaf"] == leaf(7, "de", "t") and row["verified"] and row["proof_sha256"] == H("")


def brute_negatives(rows, anchors, positives=5, negatives=5):
    once = lambda x: sorted({(i, k, tuple(map(int, v))) for i, k, v in x})
    rows, anchors = once(rows), once(anchors)
    out = []
    for a, label, x in anchors:
        scored = [(-sum(p * q for p, q in zip(x, y)), b, m) for b, m, y in rows if len(x) == len(y)]
        for p, b, _ in sorted(s for s in scored if s[2] == label and s[1] != a)[:positives]:
            band = sorted(s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)
            out += [(a, b, i + 1, c, -p, -s) for i, (s, c, _) in enumerate(band[:negatives])]
    return sorted(out)


def mined(spark, rows, anchors, **sizes):
    frame = lambda x: spark.createDataFrame(x, "vec_id long, label long, v array<double>")
    return sorted(tuple(r) for r in N.hard_negatives(frame(rows), frame(anchors), **sizes).collect())


@pytest.mark.parametrize("dim,spread,blocks", [(16, 30, {"candidates": 60, "anchor_rows": 7}), (5, 2, {})])
def test_negatives_equal_all_pairs(spark, dim, spread, blocks):
    draw = np.random.default_rng(dim)
    centres = draw.integers(-spread, spread + 1, (4, dim)) * 2
    rows = [(i, int(draw.integers(3)), [float(x) for x in centres[i % 4] + draw.integers(-spread, spread + 1, dim)]) for i in range(400)]
    hot = [float(x) for x in centres[0]]
    rows += [(1000 + i, i % 3, hot) for i in range(150)] + [rows[5], rows[5], (2000, 0, [0.0] * dim), (2001, 1, [0.0] * dim), (2002, 1, [1.0, 2.0]), (2003, 0, [3.0, 1.0]), (2004, 1, [2.0, 2.0])]
    anchors = [r for r in rows if r[0] % 20 == 0 or r[0] > 1999]
    got = mined(spark, rows, anchors, **blocks)
    assert got == brute_negatives(rows, anchors) and len(got) > 100


def test_negatives_of_large_numbers_and_of_nothing(spark):
    big = [(i, i % 2, [float(2**31 - i), float(2**30 + 3 * i), float(i)]) for i in range(12)]
    assert mined(spark, big, big[:3]) == brute_negatives(big, big[:3])
    assert mined(spark, [], []) == [] and mined(spark, big[:1], big[:1]) == []


def test_bounds_hold_and_get_tighter():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(50, 23)), draw.normal(size=(60, 23))
    last = None
    for (a, s), (b, t) in zip(N.summaries(x), N.summaries(y)):
        middle, rest = a @ b.T, s @ t.T
        assert (np.abs(x @ y.T - middle) <= rest + 1e-9).all()
        assert last is None or rest.mean() < last
        last = rest.mean()


def test_vectors_that_take_part(spark):
    rows = [(7, [1.0], 9), (8, [0.999], 3), (9, None, 1), (10, [1.0, None], 1), (11, [float("nan")], 1), (12, [1.0], None), (None, [1.0], 1), (13, [-0.001], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("k"))
    assert sorted((r["vec_id"], r["label"], r["v"]) for r in N.labelled_vectors(df).collect()) == [(7, 0, [256.0]), (8, 3, [255.0]), (13, 4, [-1.0])]
