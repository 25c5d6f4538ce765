"""The random field's gradient by differences, its decoder and spans by enumeration, and held-out F1."""

import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import tagging as G

PATTERNS = [("email", r"[a-z.]+@[a-z.]+\.[a-z]+"), ("phone", r"\+[0-9][0-9() -]+[0-9]"), ("ref", r"no [0-9]{4}")]


def test_likelihood_and_gradient():
    rng = np.random.default_rng(1)
    n_tags, buckets = 3, 40
    w, trans = rng.normal(size=(buckets, n_tags)), rng.normal(size=(n_tags, n_tags))
    windows = [(G.features(t, buckets), np.array(y)) for t, y in ((["a", "Bc", "12"], [0, 1, 2]), (["x"], [1]), (["q", "r1", "S", "a"], [2, 2, 0, 1]))]

    def value(w, trans):
        out = 0.0
        for x, y in windows:
            e = w[x].sum(1)
            score = lambda z: sum(e[i, z[i]] for i in range(len(z))) + sum(trans[a, b] for a, b in zip(z, z[1:], strict=False))  # noqa: B023, E731
            out += score(y) - np.logaddexp.reduce([score(z) for z in product(range(n_tags), repeat=len(y))])
        return out

    got, dw, dt = G.likelihood(windows, w, trans)
    assert abs(got - value(w, trans)) < 1e-9
    for a, b in [(int(x[0][0]), k) for x, _ in windows for k in range(n_tags)]:
        step = np.zeros_like(w)
        step[a, b] = 1e-6
        assert abs((value(w + step, trans) - value(w - step, trans)) / 2e-6 - dw[a, b]) < 1e-4
    for a, b in product(range(n_tags), repeat=2):
        step = np.zeros_like(trans)
        step[a, b] = 1e-6
        assert abs((value(w, trans + step) - value(w, trans - step)) / 2e-6 - dt[a, b]) < 1e-4
    tagger = G.Tagger(w, trans)
    for tokens in (["a", "Bc", "12", "x"], ["q"]):
        e = w[G.features(tokens, buckets)].sum(1)
        total = lambda z: sum(e[i, z[i]] for i in range(len(z))) + sum(trans[a, b] for a, b in zip(z, z[1:], strict=False))  # noqa: B023, E731
        assert tagger.best(tokens) == list(max(product(range(n_tags), repeat=len(tokens)), key=total))


def test_minimum_of_a_bowl():
    a = np.diag([1.0, 10.0, 100.0])
    x = G.minimised(lambda x: (float((x - 1) @ a @ (x - 1)), 2 * a @ (x - 1)), np.zeros(3), 60)
    assert np.abs(x - 1).max() < 0.02


def test_examples_and_spans(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de or +1 (30) 55-66 now no 1234"), (2, ""), (3, None), (4, "x " * 20 + "(j@k.org)")], "id long, t string")
    got = {(r["key"], r["place"]): r for r in G.examples(docs, "id", "t", PATTERNS, 8).withColumn("predicted", F.col("tags")).withColumn("s", G.spans("tags")).collect()}
    assert sorted(got) == [("1", 0), ("1", 1), ("4", 0), ("4", 1), ("4", 2)]
    assert got["1", 0]["tags"] == [0, 1, 0, 3, 4, 4, 0, 5] and got["1", 1]["tags"] == [6] and got["4", 2]["tags"] == [0, 0, 0, 0, 1]
    assert [tuple(s) for s in got["1", 0]["s"]] == [(1, 2, 0), (3, 6, 1), (7, 8, 2)] and got["1", 1]["s"] == []


def test_held_out_spans(spark):
    """Trained over partitions, more of them than are added at once; names and numbers of the held-out rows are new."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows = []
    for k in range(700):
        parts = [word() for _ in range(rng.randrange(4, 12))]
        parts.insert(rng.randrange(len(parts)), rng.choice([f"{word()}@{word()}.org", f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}", f"no {rng.randrange(1000, 9999)}", str(rng.randrange(10**5))]))
        rows.append((k, " ".join(parts)))
    whole = G.examples(spark.createDataFrame(rows, "id long, t string"), "id", "t", PATTERNS)
    part = F.pmod(F.xxhash64("key"), F.lit(4))
    train, held = whole.where(part > 0).repartition(40, "key"), whole.where(part == 0)
    model = G.fit(train, len(G.tag_names([k for k, _ in PATTERNS])), rounds=12, buckets=1 << 10)
    got = {r["kind"]: r for r in G.span_scores(model.tagged(held)).collect()}
    assert got[None]["f1"] > 0.95 and got[None]["gold"] == sum(got[k]["gold"] for k in got if k is not None) > 80
