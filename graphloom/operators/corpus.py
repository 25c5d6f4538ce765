"""Corpus clean-up: quality reasons, masking, duplicates, terms and facts in text."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import shared_dir

#: Fixed value: a number with a unit.
DOSE = r"\d+\s*(?:mg|mmHg|mmol)"
#: Fixed value: a sentence that is a section's heading only.
SECTION = r"(?i)^(?:摘要|引言|方法|结果|讨论|结论|背景|目的|对象与方法|Abstract|Introduction|Methods|Results|Discussion|Conclusion)\s*[:：]?\s*$"


def quality_reason(text: Column, ads: str, term: str, script: str, least: int = 30, terms: int = 2, share: float = 0.2, dose: str = DOSE) -> Column:
    """too_short, ads, no_term, low_script or ok: the first that holds.  Patterns are parameters of the corpus; a dose makes up for terms."""
    n = F.length(F.coalesce(text, F.lit("")))
    return (
        F.when(n < least, "too_short").when(text.rlike(ads), "ads").when((F.regexp_count(text, F.lit(term)) < terms) & ~text.rlike(dose), "no_term")
        .when(F.regexp_count(text, F.lit(script)) < n * share, "low_script").otherwise("ok")
    )


def telling_sentences(sentences: Column, term: str, least: int = 10, most: int = 300, dose: str = DOSE) -> Column:
    """The distinct sentences of fitting length that name a term or a dose and aren't a heading, in order."""
    s = F.transform(sentences, lambda x: F.regexp_replace(x, "^[ \u3000]+|[ \u3000]+$", ""))
    fits = lambda x: ~x.rlike(SECTION) & F.length(x).between(least, most) & (x.rlike(term) | x.rlike(dose))
    return F.array_distinct(F.filter(s, fits))


#: Any decimal digit and any white space count, full-width ones too.
UNICODE = "(?U)"
#: Masking rules in order (name, pattern, mask).
PII_RULES = [
    ("id", r"(?<!\d)[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)", "ID_MASKED"),
    ("mobile", r"(?<!\d)1[3-9]\d{9}(?!\d)", "PHONE_MASKED"),
    ("landline", r"(?<!\d)0\d{2,3}-?\d{7,8}(?!\d)", "TEL_MASKED"),
    ("bank", r"(?<!\d)\d{16,19}(?!\d)", "BANK_MASKED"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "EMAIL_MASKED"),
    ("record", r"(?:住院号|病历号|门诊号|病案号|医保卡号|社保号)\s*[:：]?\s*[A-Za-z0-9-]{4,20}", "MRN_MASKED"),
    ("address", r"[一-鿿]{2,8}(?:省|市|自治区|自治州)[一-鿿]{2,10}(?:市|区|县|旗|镇|乡|街道|路|街|巷|号|栋|单元|室|村|组)\s*[一-鿿0-9-]{0,20}", "ADDR_MASKED"),
    ("social", r"(?i)(?:QQ|微信|weixin|wechat)\s*(?:号|：|:)?\s*[A-Za-z0-9_-]{5,20}", "SOCIAL_MASKED"),
    ("titled_name", r"(?:患者|病人|本人|姓名|联系人)\s*[:：]?\s*[一-鿿]{2,4}", "NAME_MASKED"),
    ("surname", r"[赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄](?:某某|某|××|\*\*|XX)", "NAME_MASKED"),
    ("birth", r"(?:出生日期|出生年月|生日)\s*[:：]?\s*\d{4}[-/年]\d{1,2}(?:[-/月]\d{1,2}日?)?", "DOB_MASKED"),
]


#: Measurements, quantities and references, whose digits are no personal data.
PROTECTED = [
    r"(?:血压|收缩压|舒张压|血糖|血脂|胆固醇|甘油三酯|BMI|心率|体温|白细胞|血红蛋白|血小板|肌酐|尿素氮|转氨酶|胆红素|白蛋白|氧分压|二氧化碳|pH)\s*[:：]?\s*[\d.~-]+",
    r"\d+\s*(?:mg|g|ml|mL|L|mmHg|mmol/L|μmol/L|U/L|IU|%|次/分|°C|℃|万|亿|例|人|年|月|日|小时|分钟|周|天)",
    r"(?:PMID|DOI|doi)\s*[:：]?\s*[\d./A-Za-z-]+",
    r"ICD-?\s*\d+",
]


def masked_outside(text: Column) -> Column:
    """All rules in what lies between protected spans (leftmost, in the original text); the spans stay, and no match crosses one."""
    guard = UNICODE + "|".join(PROTECTED)
    between = F.split(text, guard)
    spans = F.concat(F.regexp_extract_all(text, F.lit(guard), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, spans, lambda t, s: F.concat(masked(t), F.coalesce(s, F.lit("")))), "")


def first_spans(df: DataFrame, key: str, text: str, aliases: list[str]) -> DataFrame:
    """key, alias, start (from 1) and stop (exclusive) of each alias's first occurrence in the text."""
    at = [F.struct(F.lit(a).alias("alias"), F.instr(F.col(text), a).alias("start"), (F.instr(F.col(text), a) + len(a)).alias("stop")) for a in aliases]
    return df.select(key, F.inline(F.filter(F.array(*at), lambda x: x["start"] > 0)))


def masked(text: Column) -> Column:
    """All rules one after the other, inside the JVM."""
    return reduce(lambda c, r: F.regexp_replace(c, UNICODE + r[1], r[2]), PII_RULES, text)


#: What a text must hold for a rule to match: one of the words, or for patterns of digits seven of them; rules without an entry are always tried.
NEEDED = {
    "email": ["@"],
    "record": ["住院号", "病历号", "门诊号", "病案号", "医保卡号", "社保号"],
    "address": ["省", "市", "自治区", "自治州"],
    "titled_name": ["患者", "病人", "本人", "姓名", "联系人"],
    "surname": ["某", "××", "**", "XX"],
    "birth": ["出生日期", "出生年月", "生日"],
}


def mask_audit(df: DataFrame, text: str) -> DataFrame:
    """rule and n, the matches in texts that earlier rules have masked; texts aren't kept.

    A rule whose words a text doesn't hold isn't tried on it, and only texts with a match are masked.
    Each rule is a projection of its own, so that its count and its text are made once.
    """
    got = df.select(F.col(text).alias("c"))
    # masks hold no digits, so that they add no run of them
    got = got.withColumn("digits", F.rlike("c", F.lit(UNICODE + r"\d{7}")))
    for name, pattern, mask in PII_RULES:
        if name in NEEDED:
            may = reduce(lambda a, b: a | b, (F.contains("c", F.lit(w)) for w in NEEDED[name]))
        else:
            may = F.lit(True) if name == "social" else F.col("digits")
        n = F.when(may, F.coalesce(F.regexp_count("c", F.lit(UNICODE + pattern)), F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))
        got = got.withColumn(f"n_{name}", n)
        got = got.withColumn("c", F.when(F.col(f"n_{name}") > 0, F.regexp_replace("c", UNICODE + pattern, mask)).otherwise(F.col("c")))
    sums = got.agg(*(F.sum(f"n_{r[0]}").alias(r[0]) for r in PII_RULES))
    rows = F.array(*(F.struct(F.lit(r[0]).alias("rule"), F.col(r[0]).alias("n")) for r in PII_RULES))
    return sums.select(F.inline(rows)).where("n IS NOT NULL")  # no rows of no texts


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the 64-bit fingerprint of character 2-grams by SHA-1 (its first 64 bits), as two halves of 32 bits (hi, lo).

    Sums of 64 votes a gram are more than one generated method can hold, so this is an
    Arrow function; a gram is hashed once for each batch, and a text costs one product of
    its gram counts with the votes.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        from collections import Counter
        from hashlib import sha1

        for batch in batches:
            votes: dict[str, int] = {}
            rows: list = []
            hi, lo = [], []
            for t in batch.column(1).to_pylist():
                t = "".join((t or "").split())
                grams = Counter(map("".join, zip(t, t[1:]))) if len(t) > 1 else Counter([t] if t else [])
                for g in grams:
                    if g not in votes:
                        votes[g] = len(rows)
                        rows.append(np.unpackbits(np.frombuffer(sha1(g.encode("utf-8", "replace")).digest()[:8], np.uint8)).astype(np.int64) * 2 - 1)
                total = sum((rows[votes[g]] * n for g, n in grams.items()), np.zeros(64, np.int64))
                value = int.from_bytes(np.packbits(total > 0).tobytes(), "big")
                hi.append(value >> 32)
                lo.append(value & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["key", "hi", "lo"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(run, "key long, hi long, lo long")


def near_pairs(prints: DataFrame, within: int = 3) -> DataFrame:
    """a < b, distance: all pairs within that many bits.

    The 64 bits are cut into within + 3 blocks: of two prints within that many bits at least three
    blocks are equal, so no pair is missed by meeting on every choice of three.  With three bits
    that is 20 keys of about 32 bits, so keys that fill at random hold few prints each.  Equal
    fingerprints are one node and are compared once.
    """
    nodes = prints.groupBy("hi", "lo").agg(F.min("key").alias("key")).select("key", F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("bits"))
    ends = [64 * k // (within + 3) for k in range(within + 4)]
    blocks = [(1 << high) - (1 << low) for low, high in pairwise(ends)]
    masks = [sum(three) for three in combinations(blocks, 3)]
    kept = F.array(*(F.col("bits").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))
    each = nodes.select("key", "bits", F.posexplode(kept).alias("mask", "part"))
    a, b = (each.select("mask", "part", F.col("key").alias(k), F.col("bits").alias(f"{k}_bits")) for k in "ab")
    d = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits")))
    return a.join(b, ["mask", "part"]).where((F.col("a") < F.col("b")) & (d <= within)).select("a", "b", d.alias("distance")).distinct()


def copies(prints: DataFrame) -> DataFrame:
    """a, b, distance (0): each key b whose fingerprint an earlier key a has, with the first such a.

    With near_pairs(), whose ends are these first keys, every pair within the bits follows.
    """
    first = prints.groupBy("hi", "lo").agg(F.min("key").alias("a"))
    return prints.join(first, ["hi", "lo"]).where(F.col("a") < F.col("key")).select("a", F.col("key").alias("b"), F.lit(0).alias("distance"))


def greedy_kept(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """The keys that a pass in key order keeps: a key goes if an earlier kept key is its near pair.

    Fixpoint: a key is settled as kept once all its earlier neighbours are out, as out once
    one is kept.  Keys without pairs are kept at once; rounds follow the longest chain, and each
    writes only what it settles and what is still open.
    """
    spark = keys.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    open_ = pairs.select("a", "b").checkpoint()  # cuts the lineage each round
    out = [spark.createDataFrame([], keys.select("key").schema)]
    while not open_.isEmpty():
        # sure: no open pair names it as the later one
        sure = open_.select(F.col("a").alias("key")).distinct().join(open_.select(F.col("b").alias("key")), "key", "left_anti")
        gone = open_.join(sure.withColumnRenamed("key", "a"), "a", "left_semi").select(F.col("b").alias("key")).distinct().checkpoint()
        out.append(gone)
        settled = gone.unionByName(sure)
        open_ = open_.join(settled.withColumnRenamed("key", "a"), "a", "left_anti").join(gone.withColumnRenamed("key", "b"), "b", "left_anti").checkpoint()
    return keys.select("key").join(reduce(DataFrame.unionByName, out), "key", "left_anti")


def term_matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, start (from 1): words that are terms; terms: term, canonical."""
    words = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("start", "term")).where(F.col("term") != "")
    return words.join(terms, "term")


def longest_first(spans: DataFrame, by: str) -> DataFrame:
    """Non-overlapping spans (start, stop), leftmost and longest first, within each group.

    A span goes if it starts before the furthest stop of longer or earlier spans that hold it.
    """
    w = Window.partitionBy(by).orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_upto", F.coalesce(F.max("stop").over(w), F.lit(-1))).where(F.col("start") >= F.col("_upto")).drop("_upto")
