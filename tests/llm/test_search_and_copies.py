"""Lexical search, odd sketches and n-gram resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import lexical_wand, minhash_odd, ngram_resample
from graphloom.llm.registry import ORACLE_SQL, QUERIES

from test_llm import edge  # noqa: F401

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    cols = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == cols
    at = [[c[0] for c in want.description].index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def ranked(docs, items, k):
    """Every document scored for every item."""
    terms = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    terms = [(i, t, Counter(t)) for i, t in terms if t]
    n_docs, n_terms = len(terms), sum(len(t) for _, t, _ in terms)
    df = Counter(x for _, _, c in terms for x in c)
    out = []
    for item, text in items:
        got = []
        for i, t, c in terms:
            m, s = 25 + 75 * len(t) * n_docs // n_terms, 0
            for x in TERM.findall((text or "").translate(LOW)):
                if x in c:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m))
            if s > 0:
                got.append((-s, i is None, i or 0, i))
        out += [(item, r, g[3], -g[0]) for r, g in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=repr)


def test_op11_edges(spark, edge):  # noqa: F811
    rows, some, _ = edge
    got = [tuple(r) for r in lexical_wand.op11_lexical_wand(spark, some).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{some}/benchmark.parquet").collect()]
    assert sorted(got, key=repr) == ranked([r[:2] for r in rows], items, 10)


def test_op11_many_shards_and_blocks(spark):
    """Small index parts, one block an item, ties by the dozen."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i if i % 11 else None, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(600)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)]
    items = [(j, " ".join(rng.choice(words) for _ in range(12))) for j in range(7)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = lexical_wand.search(d, spark.createDataFrame(items, "item_id long, text string"), k=4, block_bytes=1).collect()
    assert sorted(map(tuple, got), key=repr) == ranked(docs, items, 4)


def test_op11_skips_documents():
    """WAND finds what scoring all finds, and scores fewer documents."""
    rng = np.random.default_rng(1)
    n = 3000
    tf = [(d, t, int(rng.integers(1, 4))) for d in range(n) for t in range(6) if rng.random() < 0.5 / (t + 1) ** 2]
    doc, term, count = (np.array(x) for x in zip(*tf, strict=True))
    part = lexical_wand.Part(list(range(n)), np.full(n, 100), doc, term, count)
    query = [(t, 10 * (t + 1) ** 3) for t in range(6)]
    heap: list = []
    scored = lexical_wand.wand(part, query, heap, 10)
    all_ = sorted(((int(s), -d) for d, s in enumerate(part.score(np.arange(n), query)) if s), reverse=True)[:10]
    assert sorted(((s, x) for s, x, _ in heap), reverse=True) == all_ and scored < len(np.unique(doc)) / 2


def sets_of(text, words=4):
    w = WORD.findall((text or "").translate(LOW))
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def classes(docs, percent=80):
    """Least reachable id by all pairs."""
    sets = [sets_of(t) for _, t in docs]
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        ids[root(i)].append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    out = []
    for i, (d, _) in enumerate(docs):
        c = least[root(i)] if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def test_op12_edges(spark, edge):  # noqa: F811
    rows, some, _ = edge
    assert sorted(map(tuple, minhash_odd.op12_minhash_odd(spark, some).collect()), key=repr) == classes([r[:2] for r in rows])


def test_op12_chains_and_groups(spark):
    """Chains whose ends differ, groups round the threshold, a common passage, copies, and texts without id."""
    rng = random.Random(9)
    docs, k = [], 0

    def add(words, with_id=True):
        nonlocal k
        k += 1
        docs.append(((7919 * k) % 10007 if with_id else None, " ".join(words)))

    for _ in range(6):
        words = [f"v{rng.random():.9f}" for _ in range(90)]
        for step in range(40):  # each differs from the one before in up to three places
            words = list(words)
            for _ in range(rng.choice([0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.random():.9f}"
            add(words, step % 9 > 0)
    passage = [f"p{i}" for i in range(40)]
    for i in range(120):
        add(passage + [f"own{i}-{j}" for j in range(12 if i % 3 else 30)])
    for i in range(40):  # short ones
        add([f"s{j if j != i % 7 else 100 + i}" for j in range(6 + i % 4)])
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = minhash_odd.classes(d.repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == classes(docs)


def test_op12_sketch_estimates_and_never_turns_down_links():
    rng = np.random.default_rng(3)
    for (n, common), (k, longs) in product(((5, 4), (50, 46), (900, 810), (900, 450)), ((minhash_odd.K, minhash_odd.LONGS), (minhash_odd.WIDE_K, minhash_odd.WIDE_LONGS))):
        limit = minhash_odd.most_differing_bits(0.8, k, longs)
        u = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        a, b = u[:n], np.concatenate([u[:common], u[n : 2 * n - common]])
        j = common / (2 * n - common)
        s = [minhash_odd.samples(np.unique(x), k) for x in (a, b)]
        bits = int(np.unpackbits((minhash_odd.odd_sketch(s[0], longs) ^ minhash_odd.odd_sketch(s[1], longs)).view(np.uint8)).sum())
        assert abs((s[0] == s[1]).mean() - j) < 0.17
        estimate = 1 + 64 * longs / (4 * k) * math.log(1 - 2 * bits / (64 * longs))
        assert abs(estimate - (s[0] == s[1]).mean()) < 0.15
        assert (bits <= limit) if j >= 0.8 else j > 0.6 or bits > limit
        assert j < 0.8 or (minhash_odd.band_keys(s[0]) == minhash_odd.band_keys(s[1])).any()


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def resampled(docs, targets):
    source, target = Counter(), Counter()
    for _, t in docs:
        source.update(features(t)[1])
    for t in targets:
        target.update(features(t)[1])
    s_all, t_all = source.total(), target.total()
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000))))
    rows = []
    for i, t in docs:
        n, f = features(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_op13(spark, edge):  # noqa: F811
    rows, some, _ = edge
    asked = [r["text"] for r in spark.read.parquet(f"{some}/benchmark.parquet").collect()]
    assert sorted(map(tuple, ngram_resample.op13_ngram_resample(spark, some).collect()), key=repr) == resampled([r[:2] for r in rows], asked)
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    asked = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert sorted(map(tuple, ngram_resample.op13_ngram_resample(spark, DATA).collect()), key=repr) == resampled(docs, asked)


def test_op13_blocks_and_longer_runs(spark, monkeypatch):
    """Any block size and any number of words give the features of the texts taken alone."""
    texts = ["a b a b c", "", "c", "B a--b", "x1 y2 z3 x1 y2 z3 x1"]
    n, whose, bucket = ngram_resample.code_block(texts, ngrams=4)
    assert n.tolist() == [5, 0, 1, 3, 7]
    for k, t in enumerate(texts):
        w = re.findall(r"[a-z0-9]+", t.lower())
        want = Counter(zlib.crc32(" ".join(w[i : i + r]).encode()) % 10000 for r in range(1, 5) for i in range(len(w) - r + 1))
        assert Counter(bucket[whose == k].tolist()) == want
        assert ngram_resample.unpack(ngram_resample.pack(np.sort(bucket[whose == k]))).tolist() == sorted(bucket[whose == k].tolist())


def test_new_operators_take_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 3, "x"), (2, "a b c d e f", 4, None)], "doc_id long, text string, row int, score string").withColumn("rank", F.lit(1)).withColumn("n", F.lit(2))
    asked = spark.createDataFrame([(1, "a b", 0)], "item_id long, text string, rank int")
    assert lexical_wand.search(docs, asked).count() == 2
    assert [r["component_id"] for r in minhash_odd.classes(docs).collect()] == [1, 1]
    assert ngram_resample.resample(docs, asked).count() == 2
