"""The ten operators against brute force, round trips and held-out labels, with the edge cases in one table."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations
from math import log10

import pytest
from pyspark.sql import functions as F

from graphloom.llm import brown_lm, common, gif_media, language_nb, line_crf, mix_flow, pack_tiers, pii_semicrf, quality_fm, simhash_cover, token_parquet
from graphloom.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns of documents and some with names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, size string, pattern string, taken string, row string, held_out string"
LONG = " ".join(f"word{k % 997} of{k % 13}" for k in range(30_000))
TEXTS = [None, "", " \n\t ", "a", "a b", "A B", "one two three four", LONG, "mail me a.b@c.example.com or +1 (375) 555-4393", "x\n\ny\n x", "ÀÉ ñ 漢字", "same text here", "same text here", "line one here.\nline one here.\nother", "<|endoftext|> is text", "it's, 'quoted' ***\r\nend  two  spaces ", "\x1c odd\x85space here"]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """A folder with the edge cases, and one with empty tables."""
    rows = [(None if k == 4 else k, t, [None, "en", "fr"][k % 3], [None, "b", "", "a"][k % 4], None if k % 5 == 0 else 7, 0.5, "f", "s", "p", "t", "r", "h") for k, t in enumerate(TEXTS)]
    rows.append(rows[6])  # a row twice
    top = tmp_path_factory.mktemp("edge")
    labels = [(6, 1, 0), (7, 0, 0), (8, 1, 0), (9, 0, 0), (9, 1, 0), (11, None, 0)]
    for name, docs, lab in (("some", rows, labels), ("none", [], [])):
        spark.createDataFrame(docs, SCHEMA).write.parquet(f"{top}/{name}/documents.parquet")
        spark.createDataFrame(lab, "doc_id long, quality int, toxic int").write.parquet(f"{top}/{name}/labels.parquet")
        asked = [(0, "one two THREE three words"), (1, None), (1, "word5 of7 of7 same"), (2, "zzz"), (None, "x same")] if docs else []
        spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{top}/{name}/benchmark.parquet")
    return rows, f"{top}/some", f"{top}/none"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, edge, name):
    assert QUERIES[name](spark, edge[2]).count() == 0


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op1(spark, edge):
    got = quality_fm.op1_quality_fm(spark, edge[1]).collect()
    assert len(got) == len(edge[0]) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    got = by_id(quality_fm.op1_quality_fm(spark, "/root/testdata/sf0.01"))
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(got[i]["predicted"], q) for i, q in quality.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_op1_identity():
    """The linear-time pair score equals the sum over pairs."""
    import numpy as np

    rng = np.random.default_rng(0)
    model = quality_fm.FM(0.1, rng.normal(size=quality_fm.N_FEATURES).astype("f4"), rng.normal(size=(quality_fm.N_FEATURES, 3)).astype("f4") * 0.1)
    rows = [quality_fm.features(t or "", 5) for t in TEXTS[:7]]
    for (i, x), s in zip(rows, quality_fm.score_batch(model, rows), strict=True):
        z = 0.1 + float(model.w[i] @ x) + sum(float(model.v[i[a]] @ model.v[i[b]]) * x[a] * x[b] for a, b in combinations(range(len(i)), 2))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-4


def test_op2(spark, edge):
    rows, some, _ = edge
    got = mix_flow.op2_mix_flow(spark, some).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_flow.op2_mix_flow(spark, some).collect()))
    size = {r[0]: len(SPACE.findall(r[1] or "")) for r in rows}
    assert len(got) == len(rows) and all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = mix_flow.op2_mix_flow(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("a"), F.sum("size").alias("s"), F.first("source_size").alias("z")).collect()
    assert all(abs(r["t"] - r["a"]) <= 0.02 * r["a"] + 20 and r["s"] == r["z"] for r in sums)
    assert abs(sum(r["a"] for r in sums) - 1.5 * sum(r["s"] for r in sums)) < 1


def test_op2_targets_and_flow():
    t = mix_flow.targets({"a": 100, "b": 100, None: 100, "c": 1})
    assert t["c"] == 2.0 and t["a"] == t[None] and abs(t["a"] - 5 * (1.5 * 301 - 2) / 12) < 1e-9 and abs(sum(t.values()) - 1.5 * 301) < 1e-9
    # documents of both sources relieve the scarce one; fresh text goes before repeats
    flow = mix_flow.route({'["a"]': 10, '["a","b"]': 10, '["b"]': 0}, {"a": 10, "b": 10})
    assert flow['["a"]']["a"] == 10 and flow['["a","b"]']["b"] == 10


def test_op3(spark, edge):
    rows, some, _ = edge
    got = gif_media.op3_gif_media(spark, some).collect()
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        raw = text[r["doc_id"]].encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_op3_gif_rules():
    """Known code stream, transparency, disposal, interlacing and bad input."""
    # 3 x 1 image of a public sample's shape: codes 4 (clear), 1, 1, 1, 5 (end) with code size 2
    bits, n, stream = 0, 0, bytearray()
    for code in (4, 1, 1, 1, 5):
        bits |= code << n
        n += 3
    stream = bits.to_bytes(-(-n // 8), "little")
    assert gif_media.lzw_decode(stream, 2, 3) == bytes([1, 1, 1])
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x80, 0, 0]) + bytes([255, 0, 0, 0, 255, 0])

    def frame(samples, disposal, clear):
        codes = [4, *samples, 5]
        value = sum(c << 3 * k for k, c in enumerate(codes)).to_bytes(-(-3 * len(codes) // 8), "little")
        return b"\x21\xf9\x04" + bytes([disposal << 2 | 1, 7, 0, clear]) + b"\0" + b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0]) + b"\x02" + bytes([len(value)]) + value + b"\0"

    w, h, got = gif_media.decode(head + frame([0, 1], 1, 1) + frame([1, 1], 3, 0) + frame([0, 0], 2, 0) + b"\x3b")
    assert (w, h, [f.delay_cs for f in got]) == (2, 1, [7, 7, 7])
    assert got[0].canvas[0].tolist() == [[255, 0, 0, 255], [0, 0, 0, 0]]
    assert got[1].canvas[0].tolist() == [[0, 255, 0, 255], [0, 255, 0, 255]]
    assert got[2].canvas[0].tolist() == got[0].canvas[0].tolist()  # frame 1 was undone, frame 2 is all transparent
    one = frame([0, 1], 1, 1)
    size = one.index(b"\x02", 18)
    for bad in (b"", b"GIF89a", head, head + b"\x00", head + one[:size] + b"\xc8" + one[size + 1 :] + b"\x3b", head + frame([0], 0, 0) + b"\x3b", b"GIF89a" + b"\xff" * 4 + b"\0\0\0" + one + b"\x3b"):
        with pytest.raises(ValueError):
            gif_media.decode(bad)
    # rows of an interlaced frame come as 0, 8, then 4, then 2, 6, then the odd ones; a palette of its own
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    codes, width, out, n = [], 3, 0, 0
    for r in rows:
        codes += [4, r % 3]
    for c in [*codes, 5]:
        out |= c << n
        n += width
    value = out.to_bytes(-(-n // 8), "little")
    gif = b"GIF89a" + bytes([1, 0, 10, 0, 0, 0, 0]) + b"\x2c" + bytes([0, 0, 0, 0, 1, 0, 10, 0, 0x40 | 0x81]) + bytes([9, 9, 9, 7, 7, 7, 5, 5, 5, 3, 3, 3]) + b"\x02" + bytes([len(value)]) + value + b"\0\x3b"
    _, _, got = gif_media.decode(gif)
    assert list(got[0].samples) == [r % 3 for r in range(10)] and got[0].canvas[:, 0, 0].tolist() == [[9, 7, 5][r % 3] for r in range(10)]


def test_op3_frames(spark):
    media = gif_media.store(spark.createDataFrame([(1, "a" * 64 * 5000)], "doc_id long, text string"))
    got = gif_media.frames(media).orderBy("frame").collect()
    assert [(r["frame"], r["start_cs"], sum(r["red"])) for r in got] == [(0, 0, 64 * 4096), (1, 10, 64 * 904)]


def test_op4(spark, edge):
    got = language_nb.op4_language_nb(spark, edge[1]).collect()
    assert len(got) == len(edge[0]) and {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (0, 1, 2))
    got = language_nb.op4_language_nb(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95


def test_op4_posterior(spark):
    """The batch's posterior is that of the counts, multiplied out n-gram by n-gram."""
    import numpy as np

    docs = spark.createDataFrame([(1, "der hund bellt", "de"), (2, "die katze", "de"), (3, "the dog barks", "en"), (4, None, "en"), (5, "x", None)], "doc_id long, text string, lang string")
    model = language_nb.fit(docs, F.lit(True))
    grams = lambda t: [int(x) for b in language_nb.buckets(t) for x in b]
    count = {"de": Counter(grams("der hund bellt")) + Counter(grams("die katze")), "en": Counter(grams("the dog barks"))}
    got = {r["doc_id"]: r for r in language_nb.identify(docs, model).collect()}
    for i, t in ((1, "der hund bellt"), (2, "die katze"), (3, "the dog barks"), (5, "x")):
        z = []
        for lang in ("de", "en"):
            total = sum(count[lang].values()) + 0.1 * (1 << language_nb.BITS)
            z.append(np.log(3 / 6) + sum(np.log((count[lang][g] + 0.1) / total) for g in grams(t)))
        p = 1 / np.exp(np.array(z) - max(z)).sum()
        assert got[i]["lang_pred"] == ("de", "en")[int(np.argmax(z))] and abs(got[i]["score"] - p) < 1e-4
    assert got[4]["lang_pred"] == "und" and got[4]["score"] == 0


def brute_fingerprint(t):
    import xxhash

    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_op5(spark, edge):
    rows, some, _ = edge
    got = simhash_cover.op5_simhash_cover(spark, some).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == brute_classes([(r[0], r[1]) for r in rows])
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = simhash_cover.op5_simhash_cover(spark, "/root/testdata/sf0.01").collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == brute_classes(docs)


def brute_classes(docs):
    """Fingerprints and classes over all pairs."""
    import numpy as np

    fp = [brute_fingerprint(t) for _, t in docs]
    x, of = np.array(fp, np.uint64), list(range(len(docs)))
    while True:
        low = [min(of[j] for j in np.flatnonzero(np.bitwise_count(x ^ v) <= 2)) for v in x]
        low = [low[k] for k in low]
        if low == of:
            break
        of = low
    least = {}
    for (i, _), k in zip(docs, of):
        least[k] = min((v for v in (i, least.get(k)) if v is not None), default=None)
    return sorted((str(i), f"{f:016x}", str(least[k])) for (i, _), f, k in zip(docs, fp, of))


def test_op5_null_ids_and_chains(spark):
    """A document without id links others; a path of 1,024 closes in few rounds."""
    import random

    import numpy as np

    def values(rows):
        return spark.createDataFrame([(i, v) for i, v in rows], "doc_id long, fp long")

    real = simhash_cover.fingerprints
    try:
        simhash_cover.fingerprints = lambda docs: docs
        got = simhash_cover.classes(values([(1, 0), (None, 3), (3, 15), (None, 7 << 40)])).collect()
    finally:
        simhash_cover.fingerprints = real
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("1", "1"), ("3", "1"), ("None", "1"), ("None", "None")]
    ids, saves = list(range(1024)), []
    random.Random(1).shuffle(ids)
    save = common.save
    try:
        common.save = lambda *a, **k: saves.append(1) or save(*a, **k)
        got = simhash_cover.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
    finally:
        common.save = save
    assert len(got) == 1024 and {r["label"] for r in got} == {0} and len(saves) <= 21
    fps = np.random.default_rng(0).integers(0, 1 << 63, 20, dtype=np.uint64)
    near = np.unique(np.concatenate([fps, *[fps ^ np.uint64(1 << a | 1 << b) for a, b in ((0, 63), (20, 25), (46, 47), (5, 50))]]))
    want = {tuple(sorted((int(a), int(b)))) for a, b in combinations(near.view(np.int64), 2) if ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() <= 2}
    nodes = spark.createDataFrame([(int(v),) for v in near.view(np.int64)], "fp long")
    for blocks in (2, 3):
        assert {(r["a"], r["b"]) for r in simhash_cover.links(nodes, blocks).collect()} == want


def test_op5_one_of_each(spark):
    """One row stays of each class, with and without ids, and columns may have any names."""
    t = "some words that make a text of their own here"
    rows = [(1, t, 0.1), (2, t, 0.2), (None, t, 0.3), (None, "x " + t + " quite other text of length", 0.4), (None, "x " + t + " quite other text of length", 0.4), (5, None, 0.5), (5, "", 0.5), (7, "other words, that are nothing like the first ones", 0.6), (7, "again words with nothing like those of the others", 0.7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp double")
    got = simhash_cover.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r["fp"] for r in got.collect()) in ([0.1, 0.4, 0.5, 0.7], [0.1, 0.4, 0.5, 0.6])


def test_op5_links(spark):
    """Chains, copies and pairs at 1, 2 and 3 bits; bits that no anchor covers too."""
    values = [0, 0, 1, 3, 0b1111, 0b11111111, 1 << 63, (1 << 63) | (1 << 50) | (1 << 49), 0xABCDEF0123456789, 0xABCDEF0123456789 ^ (1 << 60) ^ 1, 0xABCDEF0123456789 ^ 0b111]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = {(r["a"], r["b"]) for r in simhash_cover.links(nodes).collect()}
    assert pairs == {(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_parquet.vocabulary())


def test_token_ids(edge):
    """Ids equal the library's for the edge texts and odd mixtures of words, marks and white space, with a small memo too."""
    import random

    from graphloom.llm import tokens

    tok, rng = tokenizer(), random.Random(2)
    parts = ["word", "Été,", "don't", "it's,", "naïve?!", " ", "\n", "  ", "漢字。", "12,", "x²;", "'s", "a'b'", "\u00a0", "\t", "é", "…", "<|endoftext|>", "ﬁx", "👩‍🚀!", "-", "l'eau,", "#tag", "a.b.c."]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts) for _ in range(12)) for _ in range(400)] + [" ".join(rng.choice(parts) for _ in range(30)) for _ in range(200)] + ["\n".join(rng.choice(parts).strip() or "x" for _ in range(9)) for _ in range(100)]
    enc, memo = tokens.Encoder(token_parquet.vocabulary()), tokens.MEMO
    for most in (memo, 20):
        tokens.MEMO = most
        for at in range(0, len(texts), 100):
            for t, ids in zip(texts[at : at + 100], enc.encode(texts[at : at + 100]), strict=True):
                assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t[:80]
    tokens.MEMO = memo


def test_op6(spark, edge):
    rows, some, _ = edge
    tok = tokenizer()
    got = pack_tiers.op6_pack_tiers(spark, some).where("doc_id <> 6 AND doc_id IS NOT NULL").collect()
    for i, t, *_ in rows:
        if i in (None, 6):
            continue
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        mine, at = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]), 0
        for r in mine:
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r["length"]
        assert at == len(ids)


def test_op6_windows():
    lengths = [1, 5, 1024, 1025, 3000, 700, 300, 130, 90, 90, 512, 513, 40, 0] * 20
    seqs = list(pack_tiers.pack(lengths))
    sizes = [sum(p[2] for p in s) for s in seqs]
    assert sum(sizes) == sum(lengths) and max(sizes) <= 1024
    assert sum(s not in (128, 256, 512, 1024) for s in sizes) <= 1
    totals = Counter()
    for g, n in zip(pack_tiers.step_groups(sizes, 8192), sizes, strict=True):
        totals[g] += n
    assert max(totals.values()) <= 8192


def test_op7(spark, edge):
    rows, some, _ = edge
    got = line_crf.op7_line_crf(spark, some).collect()
    for r in got:
        t = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        w = SPACE.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_op7_viterbi():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(30):
        e, t = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        every = [[k >> i & 1 for i in range(6)] for k in range(64)]
        total = lambda y, e=e, t=t: sum(e[i][y[i]] for i in range(6)) + sum(t[y[i]][y[i + 1]] for i in range(5))
        assert line_crf.viterbi(e, t) == max(every, key=total)


def test_op8(spark, edge):
    rows, some, _ = edge
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    cases = ["a@b.c@d.e f@g", "1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111 1111 1111 0", "4111-1111-1111-1111", "+1 (375) 555-4393 +1((( +12", "é x@y.z", "@@a@b.c", "1" * 5000 + ".1.1.1"]
    for text in [r[1] or "" for r in rows] + cases:
        want = []
        for k, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                ok = kind == "email" or kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and pii_semicrf.luhn(d) or kind == "phone" and 10 <= len(d) <= 15
                want += [(m.start(), m.end(), k)] * ok
        assert pii_semicrf.base_spans(text) == sorted(want, key=lambda s: (s[0], s[2]))
    got = by_id(pii_semicrf.op8_pii_semicrf(spark, some))
    assert (got[8]["n_email"], got[8]["n_phone"], got[8]["spans"]) == (1, 1, "email:8:25,phone:29:46")
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[7]["spans"] == ""


def test_op8_added_spans():
    """Spans that the base patterns miss; the base ones stay."""
    far = "contact " + "a" * 60 + "(at)example.com"
    assert pii_semicrf.find(far, pii_semicrf.PRIOR)[1] == [(8, 83, 0)] and pii_semicrf.redacted(far, pii_semicrf.PRIOR) == "contact [EMAIL]"
    base, every = pii_semicrf.find("ring +1 (269) 555-3296 4524132264652876 now", pii_semicrf.PRIOR)
    assert base == [] and [k for _, _, k in every] == [3, 2]
    assert pii_semicrf.redacted("hi a.b@c.de +1 (375) 555-4393 x", pii_semicrf.PRIOR) == "hi [EMAIL] [PHONE] x"


def test_op8_windows_and_dynamic_program():
    """Windows hold whole tokens; decoding one, or a whole text, equals the best of all segmentations."""
    import random

    rng = random.Random(4)
    pool = ["ring", "(269)", "555-3296", "+1", "4524132264652876", "1.2.3.4", "a@b.de", "jo(at)x.org", "mail", "w" * 90, "12", "ip"]
    for _ in range(25):
        words = [rng.choice(pool) for _ in range(7)]
        text = " ".join(words)
        tokens = [m.span() for m in re.finditer(r"\S+", text)]
        assert all(t in tokens for run in pii_semicrf.windows(text) for t in run)

        def score(i, j, k):
            a, b = pii_semicrf._trimmed(text, tokens[i][0], tokens[j - 1][1])
            before = text[slice(*tokens[i - 1])].strip(pii_semicrf._TRIM).lower() if i else ""
            if b - a < 5 or not pii_semicrf._MARK.search(text, tokens[i][0], tokens[j - 1][1]):
                return None
            return sum(pii_semicrf.PRIOR.get(f, 0.0) for f in pii_semicrf.span_features(text[a:b], before, pii_semicrf.KINDS[k], j - i)), (a, b, k)

        def best(i):
            if i == len(tokens):
                return 0.0
            return max([best(i + 1)] + [x[0] + best(j) for j in range(i + 1, min(len(tokens), i + pii_semicrf.MAX_TOKENS) + 1) for k in range(4) if (x := score(i, j, k))])

        got = pii_semicrf.decode(text, tokens, pii_semicrf.PRIOR)
        at = {(a, b, k): s for i in range(7) for j in range(i + 1, min(7, i + 5) + 1) for k0 in range(4) if (x := score(i, j, k0)) for s, (a, b, k) in [x]}
        assert abs(sum(at[g] for g in got) - best(0)) < 1e-9
        assert [s for run in pii_semicrf.windows(text) for s in pii_semicrf.decode(text, run, pii_semicrf.PRIOR)] == got


def test_op9(spark, edge):
    rows, some, _ = edge
    train, ends = Counter(), 0
    for i, t, *_ in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            train.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    got = brown_lm.op9_brown_lm(spark, some).collect()
    assert len(got) == len(rows)
    for r in got:
        w = (next(x[1] for x in rows if x[0] == r["doc_id"]) or "").encode().lower().split()
        base = sum(log10((c + 1) / (n + v + 1)) for c in [*(train[x] for x in w), ends])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(train[x] > 0 for x in w) + 1, n) and abs(r["base_score"] - base) < 1e-6 * (1 - base) and r["score"] < 0


def test_op9_beats_unigrams(spark):
    r = brown_lm.op9_brown_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


@pytest.mark.parametrize(("head", "core"), [(60_000, 512), (700, 512), (3, 2)])
def test_op9_classes(spark, monkeypatch, head, core):
    """Words told apart only by what stands before them, in the core, in the head or outside it; class bigrams are those of all words."""
    monkeypatch.setattr(brown_lm, "HEAD", head)
    monkeypatch.setattr(brown_lm, "CORE", core)
    fill = " ".join(f"f{k:03}" for k in range(600))
    texts = [fill] * 8 + [f"left a{k:04} right b{k:04}" for k in range(300) for _ in range(3)] + [f"left a{k:04} b{k:04}" for k in range(300)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, "left a0007", "left b0007", "right a0007", "right b0007", "a0007 b0008", "a0007 a0008", "left zz", ""])], "doc_id long, text string")
    model, words, units, own = brown_lm.fit(docs, F.col("doc_id") < len(texts))
    table = {r["word"]: (r["k"], r["c"]) for r in words.collect()}
    assert len(table) == model.v - 1 == 1202 and {w: c for w, (_, c) in table.items()} == Counter(w for x in texts for w in x.split())
    rows = {r["doc_id"]: r for r in brown_lm.score(units, own, model).collect()}
    got = [rows[len(texts) + k]["score"] for k in range(8)]
    assert head < 700 or got[0] > got[1] and got[3] > got[2] and got[4] > got[5]
    counted = sum(len(x.split()) + 1 for x in texts)
    of, classes = {w: k for w, (k, _) in table.items()}, len(model.base) - 2
    seq = lambda x: [classes, *(of.get(w, classes + 1) for w in x.split()), classes]
    n, row = Counter(p for x in texts for p in zip(seq(x), seq(x)[1:])), Counter()
    for (a, _), c in n.items():
        row[a] += c
    assert sum(n.values()) == counted == model.n
    assert abs((10 ** (model.transition[:, :-1] - model.base[:-1]) - 10 ** model.transition[:, -1:] / (classes + 1)).sum()) < 1e-9  # an unseen word's chance is the sum
    for (a, b), c in n.items():
        assert abs(model.transition[a, b] - log10((c + 0.1) / (row[a] + 0.1 * (classes + 1)))) < 1e-9
    # scores of all documents against sums over their tokens
    members = Counter(of.values()) + Counter({classes: 1})
    column = Counter()
    for (_, b), c in n.items():
        column[b] += c
    for k, x in enumerate([r["text"] for r in docs.orderBy("doc_id").collect()]):
        c, count = seq(x), [*(table.get(w, (0, 0))[1] for w in x.split()), len(texts)]
        emission = [log10(y + 1) - (log10(column[b] + members[b] + 1) if b <= classes else 0) for y, b in zip(count, c[1:])]
        want = sum(emission) + sum(model.transition[a, b] for a, b in zip(c, c[1:]))
        assert abs(rows[k]["score"] - want) < 1e-6 * (1 - want)


def test_op9_exchange():
    """Exchange ends where no single move raises the likelihood, against its formula over all moves."""
    import numpy as np

    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 9, (14, 14)) * (rng.random((14, 14)) < 0.5)

    def likelihood(of):
        k = int(max(of)) + 1
        n = np.zeros((k, k))
        np.add.at(n, (of[:, None], of[None, :]), pairs)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(n) - f(n.sum(0)) - f(n.sum(1))

    of = brown_lm.exchange(pairs, 12, 4, sweeps=50)
    top = likelihood(of)
    for w in range(12):
        for c in range(4):
            other = of.copy()
            other[w] = c
            assert likelihood(other) <= top + 1e-5


def test_op10(spark, edge):
    rows, some, _ = edge
    tok = tokenizer()
    got = token_parquet.op10_token_parquet(spark, some).collect()
    start = 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert any((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))) for r in got)
        start += len(ids)


def test_op10_files(spark, tmp_path):
    """Encodings, row groups, page indexes, and reads of metadata and of single documents without the rest."""
    import glob

    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/tokens"
    token_parquet.write_tokens(spark.read.parquet(f"{DATA}/documents.parquet"), path, token_parquet.vocabulary())
    files = glob.glob(f"{tmp_path}/tokens/*.parquet")
    rows = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        rows += meta.num_rows
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size < 2 * int(token_parquet.LAYOUT["parquet.block.size"])
            for c in range(group.num_columns):
                column = group.column(c)
                assert column.has_column_index and column.has_offset_index and column.compression == "ZSTD"
                assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings), column
    assert rows == spark.read.parquet(f"{DATA}/documents.parquet").count()
    plan = spark.read.schema(token_parquet.STORED).parquet(path).where("doc_id = 7").select("n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1] and "EqualTo(doc_id,7)" in plan


@pytest.mark.parametrize("which", [1, 2])
def test_stages_on_edge_tables(spark, edge, which):
    """Every stage on the edge cases and on empty tables, with columns of the operators' own names."""
    import corpus_pipeline as P

    docs = common.documents(spark, edge[which])
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, edge[which])
        assert got.columns == docs.columns and (which == 1 or got.count() == 0)
        assert got.count() <= 2 * docs.count()
    assert P.packing(spark, docs, edge[which]).groupBy("doc_id").count().count() == (0 if which == 2 else len({r[0] for r in edge[0]}))
    assert P.run(spark, edge[which]).count() >= 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = common.documents(spark, DATA)
    columns, seen = docs.columns, []
    for _, stage in P.STAGES[:-1]:
        before = docs.count()
        docs, _ = common.save(stage(spark, docs, DATA), "test-stage")
        seen.append((before, docs.count()))
        assert docs.columns == columns
    assert all(b <= a for a, b in seen[:2]) and seen[2][0] == seen[2][1]
    pieces = P.STAGES[-1][1](spark, docs, DATA)
    assert pieces.count() == P.run(spark, DATA).count() and pieces.agg(F.sum("length")).first()[0] > 0


def test_mixture_without_ids(spark):
    """Documents without id are mixed like others, and columns may have any names."""
    import corpus_pipeline as P

    rows = [(k if k % 3 else None, f"word{k} " * (5 + k % 7), "ab"[k % 2], k) for k in range(60)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, times int")
    got = P.mixture(spark, docs, "")
    assert got.columns == docs.columns
    n = {}
    for r in got.collect():
        n[r["times"]] = n.get(r["times"], 0) + 1
    assert all(v <= (4 if k == 0 else 2) for k, v in n.items())
    words = sum(len(r["text"].split()) for r in got.collect())
    total = sum(len(r[1].split()) for r in rows) + 5
    assert abs(words - 1.5 * total) < 0.1 * total
    assert sum(r["doc_id"] is None for r in got.collect()) > 15
