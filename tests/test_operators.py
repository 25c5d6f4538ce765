"""Operators that SQL doesn't cover, and text semantics on small literal cases."""

import hashlib
import random
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import text as X
from graphloom.operators import analytics as A
from graphloom.operators import assembly as B
from graphloom.operators import corpus as P
from graphloom.operators import pacing as W
from graphloom.operators import risk as M
from graphloom.operators import training as L
from graphloom.sources import formats as S
from graphloom.sources import seeds as E
from graphloom.streaming import live as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_normalize_and_sentences(spark):
    assert one(spark, "ＡＢＣ　 x\n y ", X.normalize) == "ABC x y"
    assert one(spark, None, X.normalize) == ""
    assert one(spark, "头痛。发热！ok; b", X.sentences) == ["头痛。", "发热！", "ok;", "b"]


def test_similarity(spark):
    rows = [("abc", "abc"), ("abc", "xabcx"), ("kitten", "sitting"), ("", "a"), (None, "a")]
    got = [r["s"] for r in spark.createDataFrame(rows, "a string, b string").select(X.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[:2] == [1.0, 0.82 + 0.16 * 3 / 5] and abs(got[2] - SequenceMatcher(None, "kitten", "sitting").ratio()) < 1e-12 and got[3:] == [0.0, 0.0]


def test_encryption(spark):
    key = F.lit("k" * 32)
    token = one(spark, "secret", lambda c: X.encrypted(c, key))
    assert token.startswith("v1:") and token.count(":") == 2
    assert one(spark, token, lambda c: X.decrypted(c, key)) == "secret"
    assert one(spark, token, lambda c: X.decrypted(c, F.lit("x" * 32))) is None


def test_masking_keeps_measurements(spark):
    t = "患者张三，身份证110101199003071234，电话13812345678，血压152/96 mmHg，邮箱a.b@c.com"
    got = one(spark, t, P.masked)
    assert "13812345678" not in got and "110101199003071234" not in got and "a.b@c.com" not in got and "152/96" in got
    assert one(spark, "生日　１990年1月2日，卡１234567890123456", P.masked) == "DOB_MASKED，卡BANK_MASKED"


def test_simhash_and_greedy(spark):
    texts = ["abcabcabc", "abcabcabd", "zzzzqqqq", "", None, "a", "abcabcabc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")

    def brute(t):
        t = "".join((t or "").split())
        grams = [t[i : i + 2] for i in range(len(t) - 1)] or ([t] if t else [])
        h = [int(hashlib.sha1(g.encode()).hexdigest()[:16], 16) for g in grams]
        return sum(1 << b for b in range(64) if sum(1 if x >> b & 1 else -1 for x in h) > 0)

    got = {r["key"]: r["hi"] << 32 | r["lo"] for r in P.simhash(df, "id", "t").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    prints = spark.createDataFrame([(k, 0, v) for k, v in enumerate([0, 1, 3, 7, 15, 31, 1 << 20])], "key long, hi long, lo long")
    pairs = {(r["a"], r["b"]) for r in P.near_pairs(prints).collect()}
    values = [0, 1, 3, 7, 15, 31, 1 << 20]
    assert pairs == {(a, b) for a, b in combinations(range(7), 2) if (values[a] ^ values[b]).bit_count() <= 3}
    kept, want = {r["key"] for r in P.greedy_kept(prints, P.near_pairs(prints)).collect()}, []
    for k, v in enumerate(values):
        if all((v ^ values[j]).bit_count() > 3 for j in want):
            want.append(k)
    assert kept == set(want)


def test_longest_first(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 0, 4), (1, 3, 6), (1, 6, 8)], "d long, start int, stop int")
    got = sorted((r["start"], r["stop"]) for r in P.longest_first(spans, "d").collect())
    assert got == [(0, 4), (6, 8)]


def test_risk_profiles(spark):
    high = dict(age=72, male=1, bmi=31.0, systolic_bp=172, diastolic_bp=102, fasting_glucose=9.5, total_cholesterol=6.8, ldl=4.4, hdl=0.8, triglycerides=3.2, smoking=1, drinking=1, family_history=2, symptom_score=3.0, low_activity=1)
    low = dict.fromkeys(high, None) | dict(age=25, male=0, bmi=21.0, systolic_bp=112, fasting_glucose=4.8)
    names = list(high)
    kinds = ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame([(1, *(float(high[n]) for n in names)), (2, *(None if low[n] is None else float(low[n]) for n in names))], f"id long, {kinds}")
    health = {r["id"]: r["health"] for r in M.health(M.predict(df, "id"), "id").collect()}
    assert health[1] < 30 < 80 < health[2]


def test_formats(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"diseases": [{"name": "d", "symptoms": ["a", "", "a", "b"]}]}')
    docs = S.seed_documents(spark, str(tmp_path / "s.json"), "name:string, symptoms:array<string>")
    assert sorted(r["target"] for r in S.shred(docs).collect()) == ["a", "b"]
    (tmp_path / "b.json").write_text('[{"name": "d", "symptoms": ["a"]}]')
    assert S.seed_documents(spark, str(tmp_path / "b.json"), "name:string, symptoms:array<string>").count() == 1
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in S.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]
    S.write_jsonl(spark.createDataFrame([("x", "", [])], "a string, b string, c array<string>"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"x"}']
    (tmp_path / "c.csv").write_text("age,bmi,dx_x\n1,,1\n2,3,0\n")
    features, labels = S.cohort(spark, str(tmp_path / "c.csv"))
    assert sorted((r["age"], r["bmi"]) for r in features.collect()) == [(1.0, 0.0), (2.0, 3.0)]
    assert sorted((r["disease"], r["label"]) for r in labels.collect()) == [("x", 0), ("x", 1)]
    (tmp_path / "a.xml").write_text('<Set><Article><PMID>7</PMID><Title>T</Title><Abstract><AbstractText Label="AIM">a</AbstractText><AbstractText>b</AbstractText></Abstract><MedlineDate>2001 Spring</MedlineDate></Article></Set>')
    row = S.articles(spark, str(tmp_path / "a.xml")).first()
    assert (row["pmid"], row["abstract"], row["year"]) == ("7", "AIM: a\nb", 2001)


def test_sql_gate(spark):
    from graphloom.operators.sqlgate import is_query

    assert is_query(spark, "SELECT 1") and is_query(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a ORDER BY x LIMIT 3")
    for bad in ("DROP TABLE a", "INSERT INTO a SELECT 1", "CREATE TABLE a AS SELECT 1", "DELETE FROM a", "not sql", "SET x = 1", "ALTER TABLE a RENAME TO b"):
        assert not is_query(spark, bad), bad


def test_fuzzy_mentions(spark):
    from graphloom.operators import answers as A

    names, lengths = ["kitten", "sitting", "mat"], (8, 7, 6, 5, 4, 3, 2)
    texts = ["a kiten sat on the mat", "sitting kitten", "", None, "zz", "mat mat kittens sittin"]

    def ratio(a, b):
        if a == b:
            return 1.0
        return 0.82 + 0.16 * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else SequenceMatcher(None, a, b).ratio()

    want = []
    for k, t in enumerate(texts):
        taken = []
        for size in lengths:
            for i in range(len(t or "") - size + 1):
                part = t[i : i + size].strip()
                if part and all(i + size <= s or i >= e for s, e in taken):
                    scores = [ratio(part, n) for n in names]
                    if max(scores) >= 0.72:
                        want.append((str(k), i, i + size, names[scores.index(max(scores))], round(max(scores) * 0.85, 4)))
                        taken.append((i, i + size))
                        break
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = A.fuzzy_mentions(docs, "id", "t", names).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_markdown_html(spark):
    from graphloom.operators import answers as A

    assert one(spark, "## A & B\n**b** [KG-2]\n### c", A.markdown_html) == '<h4>A &amp; B</h4><br/><strong>b</strong> <sup class="kg-cite" data-cite="KG-2">[KG-2]</sup><br/><h5>c</h5>'
    assert one(spark, None, A.markdown_html) == ""


def test_symptom_score(spark):
    rows = [(["头痛", "剧烈胸痛", "其他"],), ([None],), ([],), (None,), (["胸痛"] * 9,)]
    got = [r["s"] for r in spark.createDataFrame(rows, "x array<string>").select(M.symptom_score(F.col("x")).alias("s")).collect()]
    assert got == [1.7, 0.48, 0.0, 0.0, 5.0]


def test_viterbi(spark):
    import random
    from itertools import product

    from graphloom.operators import answers as A

    rng = random.Random(5)
    start, end = ([rng.uniform(-1, 1) for _ in range(3)] for _ in range(2))
    trans = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(3)]
    seqs = [[[rng.uniform(-1, 1) for _ in range(3)] for _ in range(n)] for n in (0, 1, 2, 5, 6)]

    def total(e, p):
        return start[p[0]] + end[p[-1]] + sum(e[i][t] for i, t in enumerate(p)) + sum(trans[a][b] for a, b in zip(p, p[1:], strict=False))

    want = [list(max(product(range(3), repeat=len(e)), key=lambda p: total(e, p))) if e else [] for e in seqs]
    df = spark.createDataFrame(list(enumerate(seqs)), "k int, e array<array<double>>")
    got = {r["k"]: r["t"] for r in df.select("k", A.viterbi(F.col("e"), start, trans, end).alias("t")).collect()}
    assert [got[k] for k in range(len(seqs))] == want


def test_pattern_triples(spark):
    from graphloom.operators import relations as R

    t = "本病表现为咳嗽、咳痰和12%。常用阿莫西林、头孢等药物；应就诊于呼吸内科。需行胸片，血常规。易并发肺心病；需与哮喘鉴别"
    got = R.pattern_triples(spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, text string"), ["id"], "text", lexicon={"HAS_SYMPTOM": ["咳痰"]}).collect()
    found = {(r["rel"], r["tail"]): r["confidence"] for r in got}
    assert {r["id"] for r in got} == {1} and len(found) == len(got)
    assert found[("HAS_SYMPTOM", "咳嗽")] == 0.9 and found[("HAS_SYMPTOM", "咳痰")] == 0.95 and ("HAS_SYMPTOM", "12%") not in found
    assert found[("USES_DRUG", "阿莫西林")] == 0.86 and ("NEEDS_CHECK", "血常规") in found and ("HAS_COMPLICATION", "肺心病") in found
    assert ("BELONGS_TO", "呼吸内科") in found and ("DIFFERENTIAL_WITH", "哮喘鉴别") in found


def test_paths_over_all_edges(spark):
    from graphloom.plans.catalogue import QUERIES
    from graphloom.plans.graph import edges

    d = "/root/testdata/sf0.001"
    have = edges(spark, d).collect()
    near = {}
    for r in have:
        near.setdefault(r["source"], set()).add(r["target"])
        near.setdefault(r["target"], set()).add(r["source"])
    want, open_ = set(), [("C1",)]
    for _ in range(3):
        open_ = [(*p, x) for p in open_ for x in near[p[-1]] if x not in p]
        want |= {p for p in open_ if p[-1] == "C2"}
        open_ = [p for p in open_ if p[-1] != "C2"]
    got = QUERIES["g_paths_le3"](spark, d).collect()
    assert sorted((r["path"], r["hops"]) for r in got) == sorted((">".join(p), len(p) - 1) for p in want)
    assert any(x[0] == "P" for p in want for x in p)  # by way of a symptom, too
    steps = QUERIES["g_path_steps"](spark, d).collect()
    assert len(steps) == sum(len(p) - 1 for p in want)
    there = {(r["source"], r["rel"], r["target"]) for r in have}
    assert all(((r["node"], r["rel"], r["other"]) if r["direction"] == "out" else (r["other"], r["rel"], r["node"])) in there for r in steps)
    least = min(len(p) for p in want)
    one = QUERIES["g_shortest_path"](spark, d).collect()
    assert [(r["path"], r["hops"]) for r in one] == [(">".join(min(p for p in want if len(p) == least)), least - 1)]


def test_link_scores_through_hubs(spark):
    from math import log

    from graphloom.operators import rules as R

    to = {f"a{k:03}": {"hub", *(["rare"] if k < 3 else []), f"own{k % 50}"} for k in range(90)}
    rows = [(a, x) for a, t in to.items() for x in t]
    got = {(r["a"], r["b"]): r for r in R.link_scores(spark.createDataFrame(rows, "source string, target string")).collect()}
    deg = {x: sum(x in t for t in to.values()) for x in set().union(*to.values())}
    assert deg["hub"] == 90 and set(got) == set(combinations(sorted(to), 2))
    for (a, b), r in got.items():
        both = to[a] & to[b]
        want = (sum(1 / log(deg[x]) for x in both if deg[x] > 2), len(both) / len(to[a] | to[b]), len(both) / min(len(to[a]), len(to[b])))
        assert all(abs(x - r[c]) < 1e-9 for x, c in zip(want, ("aa", "jaccard", "overlap"), strict=True))


def test_resolve_misses_no_similar_name(spark):
    import random

    from graphloom.operators import graph as G
    from graphloom.plans.catalogue import QUERIES

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdxy ") for _ in range(r.randint(1, 9)))
    texts, names = sorted({"abxcdxef", "abc", "b", *(word() for _ in range(60))}), sorted({"abycdyef", "abd", "abcdefghijk", *(word() for _ in range(60))})
    left, right = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(f"n{k:03}", x) for k, x in enumerate(names)], "id string, name string")

    def ratio(a, b):
        a, b = a.strip(), b.strip()
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        return 0.82 + 0.16 * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else SequenceMatcher(None, a, b).ratio()

    got = {(x["text"], x["name"]) for x in G.alike(left, right, 0.62).collect()}
    assert got == {(a, b) for a in texts for b in names if ratio(a, b) >= 0.62}
    assert {("abxcdxef", "abycdyef"), ("abc", "abd"), ("b", "abcdefghijk")} <= got
    tiers = {x["tier"] for x in QUERIES["g_resolve_names"](spark, "/root/testdata/sf0.001").collect()}
    assert tiers == {1, 3}


def test_protected_spans_stay(spark):
    """Digits of measurements stay, others are masked; no match crosses a protected span."""
    from graphloom.operators import corpus as P

    rows = [("血压 13812345678 电话13812345678", "血压 13812345678 电话PHONE_MASKED"), ("12345678901234567 mg and 1234567890123456", "12345678901234567 mg and BANK_MASKED"), ("李某 PMID: 13812345678", "NAME_MASKED PMID: 13812345678"), ("", ""), (None, None), ("a@b.cd 10年", "EMAIL_MASKED 10年"), ("电话1３８12345６78，卡 １234567890123456", "电话1３８12345６78，卡 BANK_MASKED"), ("电话13８12345６78 血压 １52/96　mmHg 生日　１990年1月", "电话PHONE_MASKED 血压 １52/96　mmHg 生日　１990年1月")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    got = {r["k"]: r["m"] for r in df.select("k", P.masked_outside(F.col("t")).alias("m")).collect()}
    assert [got[k] for k in range(len(rows))] == [want for _, want in rows]


def test_similar_names_by_brute_force(spark):
    from difflib import SequenceMatcher

    from graphloom.operators import retrieval as Q

    names = ["alpha", "alphabet", "an alpha", "x alpha y", "alpah", "beta", "alphq", ""]
    nodes = spark.createDataFrame([(f"n{k}", x) for k, x in enumerate(names)], "id string, name string")

    def score(name, seed):
        if name.startswith(seed):
            return 0.94
        if name.endswith(seed):
            return 0.88
        return 0.8 if seed in name else round(SequenceMatcher(None, name, seed).ratio(), 3)

    want = sorted(((score(x, "alpha"), f"n{k}") for k, x in enumerate(names) if x and x != "alpha"), key=lambda p: (-p[0], p[1]))
    want = [(i, s) for s, i in want if s >= 0.45][:4]
    got = [(r["id"], r["score"]) for r in Q.similar(nodes.where("name <> ''"), ["alpha"], 4).orderBy(F.desc("score"), "id").collect()]
    assert got == want


def test_keywords_against_occupied_places(spark):
    lexicon = {"a": ["ab", "abc", "b"], "b": ["c", "bc"], "c": ["a"]}
    texts = ["abcabab", "bcbc", "", None, "xyz", "aabbcc", "cab" * 40]

    def brute(text):
        text, taken, hits = text or "", set(), {}
        for cls, words in lexicon.items():
            for w in sorted(words, key=lambda w: (-len(w), w)):
                for i in range(len(text) - len(w) + 1):
                    if text[i : i + len(w)] == w and not taken & set(range(i, i + len(w))):
                        taken |= set(range(i, i + len(w)))
                        hits[cls, w] = hits.get((cls, w), 0) + 1
        score = {c: sum(n * len(w) for (k, w), n in hits.items() if k == c) for c in lexicon}
        best = max(score.values())
        return hits, next(c for c in lexicon if score[c] == best) if best else "none", [float(i in taken) for i in range(8)]

    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", T.keyword_state(F.col("t"), lexicon))
    for r in df.select("t", "s.hits", T.keyword_class(F.col("s.hits"), lexicon, "none").alias("k"), T.keyword_mask(F.col("t"), lexicon, 8).alias("m")).collect():
        assert ({(h["class"], h["word"]): h["n"] for h in r["hits"]}, r["k"], r["m"]) == brute(r["t"])


def test_answer_checks(spark):
    good = "肺炎的常见症状包括发热与咳嗽，请及时就医[KG-1]。\n本回答不能替代执业医师诊断"
    rows = [
        (1, good, ["肺炎"], 1),
        (2, "肺炎的常见症状包括发热与咳嗽等等情况。建议每日3次，每次5mg。一定是它。诊断为肺炎。[KG-9][KG-9]", ["肺炎"], 2),
        (3, "不能仅凭描述诊断为任何问题。不能替代执业医师", [], 0),
        (4, None, None, 0),
        (5, "可能患有奇怪综合征。不能替代执业医师", ["肺炎"], 1),
    ]
    got = B.check(spark.createDataFrame(rows, "id int, a string, names array<string>, n int"), "id", "a", "names", "n").cache()
    kinds = {}
    for r in got.collect():
        kinds.setdefault(r["id"], []).append(r["kind"])
    assert 1 not in kinds and 3 not in kinds and kinds[4] == ["missing_disclaimer"] and kinds[5] == ["unknown_entity"]
    assert sorted(kinds[2]) == ["absolute_claim", "diagnostic_claim", "dose_violation", "dose_violation", "invalid_citation", "missing_citation", "missing_disclaimer"]
    v = {r["id"]: (r["n"], r["score"], r["action"]) for r in B.verdict(got, "id").collect()}
    assert v[2] == (7, 0.0, "fallback_template") and v[4] == (1, 0.98, "accept")


def test_best_match(spark):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "EUROPE"]
    texts = ["AMERICAN", "asia", "EUROP", "", "AFRIC A", "zzz", "ASIA"]

    def sim(a, b):
        a, b = a.strip(), b.strip()
        if not a or not b:
            return 0.0
        return 1.0 if a == b else 0.82 + 0.16 * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else SequenceMatcher(None, a, b).ratio()

    for r in B.best_match(spark.createDataFrame([(t,) for t in texts], "text string"), names).collect():
        best = max(names, key=lambda c: sim(r["text"], c))
        want = (best, sim(r["text"], best)) if sim(r["text"], best) >= 0.55 else (None, 0.0)
        assert r["match"] == want[0] and abs(r["score"] - want[1]) < 1e-12


def test_seed_readers(spark, tmp_path):
    (tmp_path / "s.txt").write_text("// head\nCREATE a;\n\nMATCH b // why\nRETURN b;\n ;")
    got = [(r["line"], r["statement"].split()) for r in E.statements(spark, str(tmp_path / "s.txt")).orderBy("place").collect()]
    assert got == [(2, ["CREATE", "a"]), (4, ["MATCH", "b", "RETURN", "b"])]
    (tmp_path / "d.jsonl").write_text('{"question": " q ", "answer": "a"}\n{"prompt": "p"}\nbroken\n{"instruction": "", "prompt": "p", "response": "r", "system": "s", "input": "i"}\n')
    assert {tuple(r) for r in E.dialogues(spark, str(tmp_path / "d.jsonl"), "me").collect()} == {("me", "q", "", "a"), ("s", "p", "i", "r")}
    (tmp_path / "i.json").write_text('[{"text": "x", "label": "a"}, {"text": "y", "label": "z"}, {"text": " ", "label": "a"}]')
    assert [tuple(r) for r in E.intents(spark, str(tmp_path / "i.json"), ["a", "b"]).collect()] == [("x", "a")]
    assert E.or_empty(spark, str(tmp_path / "none"), "a string").count() == 0


def test_split_of_ties_nulls_and_small_labels(spark):
    rows = [(i, None if i % 7 == 0 else "big" if i % 3 else "small") for i in range(3000)] + [(9000, "one")]
    got = E.stratified_split(spark.createDataFrame(rows, "id long, label string"), "label", "id", 0.15).collect()
    want = set()
    for label in {x for _, x in rows}:
        ids = sorted((i for i, x in rows if x == label), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        want |= set(ids[: int(0.15 * len(ids))])
    assert len(got) == len(rows) and {r["id"] for r in got if r["is_dev"]} == want


def test_synthetic_cohort_and_trees(spark, tmp_path):
    x = E.synthetic_labels(E.synthetic_cohort(spark, 4000, 7, 2), "hypertension", 7)
    m = x.agg(F.avg("age").alias("age"), F.avg("family_history").alias("family"), F.avg("symptom_score").alias("load"), F.min("bmi").alias("low"), F.max("bmi").alias("high"), F.avg("label").alias("y")).first()
    assert abs(m["age"] - 52.5) < 1.5 and abs(m["family"] - 0.55) < 0.06 and abs(m["load"] - 1.05) < 0.1 and 15 <= m["low"] <= m["high"] <= 45 and 0.1 < m["y"] < 0.9
    assert x.select("id", "label").collect() == E.synthetic_labels(E.synthetic_cohort(spark, 4000, 7, 2), "hypertension", 7).select("id", "label").collect()
    features = ["age", "bmi", "systolic_bp"]
    model = L.fit(x.where("id % 2 = 0"), x.where("id % 4 = 1"), features, "label", rounds=4, depth=3)
    scored = model.score(x.where("id % 4 = 3"))
    e = L.evaluate(scored, "label").first()
    assert e["auc"] > 0.75 and e["brier"] < 0.25 and abs(e["sensitivity"] + e["specificity"] - 1 - e["j"]) < 1e-6
    model.save(str(tmp_path / "m"))
    again = L.Boosted.load(str(tmp_path / "m"), features).score(x.where("id % 4 = 3"))
    assert scored.select("id", "risk").collect() == again.select("id", "risk").collect()
    assert model.score(x.limit(1).withColumn("bmi", F.lit(None).cast("double"))).first()["risk"] is not None


def test_running_totals(spark):
    rng = random.Random(7)
    values = [None, 0.0, -1e300, 1e300, *(rng.uniform(-5, 5) for _ in range(3000)), *(float(k) for k in range(1, 400))]
    rows = [(v, rng.randrange(9)) for v in values]
    df = spark.createDataFrame(rows, "v double, n long").repartition(5)
    place = lambda v: (v is not None, v or 0.0)
    for falling in (False, True):
        total, want = 0, {}
        for v, n in sorted(rows, key=lambda r: place(r[0]), reverse=falling):
            total += n
            want[v] = total
        assert {r["v"]: r["upto"] for r in A.running(df, "v", {"upto": "n"}, falling).collect()} == want
    assert A.running(df.where("false"), "v", {"upto": "n"}).count() == 0
    assert [r["upto"] for r in A.running(spark.createDataFrame([(None, 4)], "v double, n long"), "v", {"upto": "n"}).collect()] == [4]


def test_near_pairs_on_random_prints(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:40]:  # copies with up to five bits turned, over all places
        for _ in range(3):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    values = sorted(set(values))
    prints = spark.createDataFrame([(k, v >> 32, v & 0xFFFFFFFF) for k, v in enumerate(values)], "key long, hi long, lo long")
    for within in (0, 1, 3, 5):
        got = {(r["a"], r["b"], r["distance"]) for r in P.near_pairs(prints, within).collect()}
        far = ((a, b, (values[a] ^ values[b]).bit_count()) for a, b in combinations(range(len(values)), 2))
        assert got == {x for x in far if x[2] <= within}
    assert P.near_pairs(prints.where("false")).count() == 0


def test_pauses_and_retries(spark):
    log = [("a", k, s) for k, s in enumerate([200, 429, 429, 200, None, 403] + [429] * 9 + [200] * 40)] + [(None, 0, 429), ("b", 0, 200)]
    want, pause = [], 5.0
    for _, _, s in log[:-2]:
        pause = min(pause * 1.8, 120.0) if s in (429, 403) else max(pause * 0.9, 5.0) if s == 200 else pause
        want.append(pause)
    df = spark.createDataFrame(log, "client string, seq int, status int").repartition(3).withColumn("id", F.col("seq"))
    got = {(r["client"], r["id"]): r["pause"] for r in W.pauses(df, "id").collect()}
    assert [got["a", k] for k in range(len(want))] == want and got[None, 0] == 9.0 and got["b", 0] == 5.0
    rows = spark.createDataFrame([(503, 0), (408, 2), (503, 3), (404, 0), (None, 1)], "s int, k int")
    assert [r["d"] for r in rows.select(W.retry_delay(F.col("s"), F.col("k")).alias("d")).collect()] == [1.0, 4.0, None, None, None]


def test_features_of_requests(spark):
    asked = spark.createDataFrame([(1, 60, "male", 30.0, True, ["a"] * 6, "LOW"), (2, None, None, None, None, None, None)], "id int, age int, gender string, bmi double, smoking boolean, family_history array<string>, physical_activity string")
    a, b = M.features(asked).orderBy("id").collect()
    assert (a["age"], a["male"], a["bmi"], a["smoking"], a["family_history"], a["low_activity"], a["ldl"]) == (60.0, 1.0, 30.0, 1.0, 4.0, 1.0, 2.9)
    assert (b["age"], b["male"], b["bmi"], b["smoking"], b["family_history"], b["low_activity"], b["symptom_score"]) == (0.0, 0.0, 23.5, 0.0, 0.0, 0.0, 0.0)


def test_streams_of_many_files_in_any_order(spark, tmp_path):
    """Days, distinct ids and session totals are whole although later files hold older rows."""
    e, there = spark.read.parquet("/root/testdata/sf0.001/events.parquet"), tmp_path / "in"
    there.mkdir()
    for k, days in enumerate([(20, 99), (0, 10), (10, 20), (0, 3)]):  # the last one repeats rows
        first = F.lit("2024-01-01").cast("timestamp_ntz")
        part = e.where((F.datediff("ts", first) >= days[0]) & (F.datediff("ts", first) < days[1]))
        part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (name,) = (tmp_path / f"part{k}").glob("*.parquet")
        name.rename(there / f"events{k}.parquet")
    folder = "file://" + str(tmp_path / "out")
    stream = lambda: V.events(spark, str(there), per_trigger=1)
    ids = V.run_once(V.deduplicated(stream(), ["event_id"], V.WHOLE).select("event_id"), folder, "append")
    assert sorted(r["event_id"] for r in ids.collect()) == sorted(r["event_id"] for r in e.select("event_id").collect())
    rows = spark.read.parquet(str(there / "events*.parquet"))
    totals = V.run_once(V.session_totals(stream(), V.WHOLE), folder, "update").groupBy("user_id").agg(F.max("n").alias("n"))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, rows.groupBy("user_id").count().collect()))
    days = V.run_once(V.tumbling(stream(), "1 day"), folder, "complete")
    assert days.agg(F.sum("n")).first()[0] == rows.count()


def test_fuzzy_mentions_align_few_windows(spark, monkeypatch):
    """Windows without a name's letters aren't aligned; blank ends, texts of any length and other characters change nothing."""
    import random

    import pandas as pd

    from graphloom.operators import answers as A

    rng, tried = random.Random(4), []
    texts = ["".join(rng.choice("kitens agm　\U00020000") for _ in range(rng.randrange(40))) for _ in range(200)] + ["xyzw " * 2000]
    similar = A.similar
    monkeypatch.setattr(A, "similar", lambda a, b, least: tried.append(a) or similar(a, b, least))
    monkeypatch.setattr(A, "TOGETHER", 500)

    class Frame:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            self.run = run
            return self

        def withColumnRenamed(self, *_):  # noqa: N802
            return self

    names = ["kitten", "a mat", "st"]
    got = next(A.fuzzy_mentions(Frame(), "k", "t", names).run(iter([pd.DataFrame({"k": range(len(texts)), "t": texts})])))
    assert not any(len(x) > 1 and set(x) <= set("xyzw ") for x in tried)
    want = []
    for k, t in enumerate(texts):
        taken = []
        for size in (8, 7, 6, 5, 4, 3, 2):
            for i in range(len(t) - size + 1):
                part = t[i : i + size].strip()
                if part and all(i + size <= s or i >= e for s, e in taken):
                    name, s = max(((n, similar(part, n, 0.72)) for n in names), key=lambda x: x[1])
                    if s:
                        want.append((k, i, i + size, name, round(s * 0.85, 4)))
                        taken.append((i, i + size))
                        break
    assert want and list(got.itertuples(index=False, name=None)) == want


def test_mask_audit_equals_rule_after_rule(spark):
    import random

    from graphloom.operators import corpus as P

    rng = random.Random(2)
    bits = ["110101199003071234", "13912345678", "010-12345678", "6222021234567890123", "a.b@c.de", "住院号：AB1234", "北京市海淀区中关村", "QQ 12345678", "weixin_abcde", "WECHAT：abc_12", "患者王小明", "张某某", "李XX", "出生日期 1990-01-02", "word", "１３９１２３４５６７８", " "]
    texts = [(" " if rng.random() < 0.5 else "").join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c, want = F.col("t"), []
    for name, pattern, mask in P.PII_RULES:
        want.append(F.sum(F.coalesce(F.regexp_count(c, F.lit(P.UNICODE + pattern)), F.lit(0))).alias(name))
        c = F.regexp_replace(c, P.UNICODE + pattern, mask)
    want = df.agg(*want).first().asDict()
    assert all(want.values()) and {r["rule"]: r["n"] for r in P.mask_audit(df, "t").collect()} == want
    assert P.mask_audit(df.where("false"), "t").count() == 0


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    import math
    import random

    from graphloom.operators import analytics as A

    rng = random.Random(3)
    v = {k: [float(rng.randrange(-3, 4)) for _ in range(4)] or None for k in range(60)}
    v = {k: x if any(x) else [1.0] * 4 for k, x in v.items()}
    df = spark.createDataFrame(sorted(v.items()), "id long, vector array<double>")
    monkeypatch.setattr(A, "ASKED", 3)
    monkeypatch.setattr(A, "LOOKED_AT", 7)
    got = A.nearest(df, df.where("id % 10 = 0"), 5)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    for q in range(0, 60, 10):
        want = sorted((-round(cos(v[q], v[i]), 9), i) for i in v if i != q)[:5]
        assert [r["id"] for r in got.where(F.col("q") == q).orderBy("k").collect()] == [i for _, i in want]


def test_pairs_within_groups_are_not_shuffled(spark, monkeypatch):
    import random

    from graphloom.operators import graph as G

    monkeypatch.setattr(G, "DEALT", 3)
    rng = random.Random(5)
    rows = sorted({(rng.randrange(4), f"n{rng.randrange(25)}") for _ in range(50)})
    got = G.pairs_within(spark.createDataFrame(rows, "k int, name string"), "k", "name")
    of = {}
    for k, n in rows:
        of.setdefault(n, set()).add(k)
    assert {(r["a"], r["b"], r["n"]) for r in got.collect()} == {(a, b, len(of[a] & of[b])) for a in of for b in of if a < b and of[a] & of[b]}
    single = spark.createDataFrame([(n % 2, f"m{n}") for n in range(20)], "k int, name string")
    assert G.pairs_within(single, "k", "name").count() == 90
