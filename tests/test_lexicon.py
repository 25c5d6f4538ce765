"""Dictionary search and labelled sentences against brute force."""

import random
import re

from graphloom.operators import lexicon as L


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8]))) for _ in range(60)]
    rows = [(k, rng.choice(["", " ", "-"]).join(rng.choice(words) for _ in range(rng.choice([0, 3, 30])))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "aé漢字abcé")], sorted({w for w in words if len(w) > 1} | {"é漢", "漢字a"})


def longest(text, terms):
    """Regular expressions take the first alternative that matches, so the longest goes first."""
    pattern = re.compile("|".join(map(re.escape, sorted(terms, key=lambda t: (-len(t), t)))))
    return [(m.start() + 1, m[0]) for m in pattern.finditer(text or "")]


def test_matches_equal_brute_force(spark):
    rows, terms = texts(80, 1)
    docs = spark.createDataFrame(rows, "id long, t string").repartition(4)
    table = spark.createDataFrame([(t,) for t in terms] + [(terms[0],), (None,), ("",)], "term string")
    want = sorted((k, a, w) for k, t in rows for a, w in longest(t, terms))
    assert len(want) > 300
    for chars in (1 << 20, 60, 7):  # one block, some, and nearly one a term
        assert sorted(map(tuple, L.matches(docs, "id", "t", table, chars).collect())) == want
    assert L.matches(docs, "id", "t", table.where("false")).count() == 0
    assert L.matches(docs.where("false"), "id", "t", table).count() == 0


def test_hundred_thousand_terms(spark):
    rng = random.Random(2)
    terms = {"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6, 12))) for _ in range(100_000)}
    some = sorted(terms)
    text = [(k, "x".join(rng.choice(some) for _ in range(200))) for k in range(8)]
    got = L.matches(spark.createDataFrame(text, "id long, t string"), "id", "t", spark.createDataFrame([(t,) for t in some], "term string"))
    sizes = range(11, 5, -1)

    def brute(t):
        out, i = [], 0
        while i < len(t):
            n = next((n for n in sizes if t[i : i + n] in terms), 0)
            if n:
                out.append((i + 1, t[i : i + n]))
            i += n or 1
        return out

    assert sorted(map(tuple, got.collect())) == sorted((k, a, w) for k, t in text for a, w in brute(t))


def test_labelled_sentences(spark):
    rng = random.Random(3)
    names = [f"e{k}" for k in range(8)]
    mentions = sorted({(rng.randrange(12), rng.randrange(40), rng.choice(names)) for _ in range(70)})
    facts = {(rng.choice(names), rng.choice("rs"), rng.choice(names)) for _ in range(14)}
    got = L.supervised(spark.createDataFrame(mentions, "k long, start int, term string"), spark.createDataFrame([(n, n.upper(), "T") for n in names], "term string, id string, type string"), spark.createDataFrame([(a.upper(), r, b.upper()) for a, r, b in facts], "source string, rel string, target string"), ["k"])
    want = set()
    for k in range(12):
        own = sorted((s, t.upper()) for j, s, t in mentions if j == k)
        for a, r, b in {(a.upper(), r, b.upper()) for a, r, b in facts}:
            pairs = [(abs(x - y), x, y) for x, s in own for y, t in own if s == a and t == b and a != b]
            if pairs:
                want.add((k, a, b, *min(pairs)[1:], r))
        near = {}
        for (x, s), (y, t) in zip(own, own[1:], strict=False):
            if s != t and not any({a.upper(), b.upper()} == {s, t} for a, _, b in facts):
                near[s, t] = min(near.get((s, t), (x, y)), (x, y))
        want |= {(k, s, t, x, y, "NA") for (s, t), (x, y) in near.items()}
    assert {tuple(r) for r in got.collect()} == want
