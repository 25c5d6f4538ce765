"""What goes round an answer: checks against its facts, context text, link scores, sealed and allowed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X

from .retrieval import SEVERITY_COST, lookup

#: Severity of each kind of violation.
SEVERITY = {"missing_citation": "medium", "invalid_citation": "high", "unknown_entity": "medium", "dose_violation": "critical", "absolute_claim": "high", "diagnostic_claim": "high", "missing_disclaimer": "low"}
#: Patterns and words of the checks; they are defaults of `check`.
DEFAULTS = {
    "cite": r"\[KG-([0-9]+)\]",
    "line": r"^\s*(?:#{1,6}\s|>\s|\*\*[^*\n]{1,14}\*\*\s*[：:])",
    "entity": [
        r"[一-鿿]{2,10}(?:综合征|综合症|感染|硬化|梗死|栓塞|衰竭|障碍|溃疡|结石|贫血|病|症|炎|癌|瘤)",
        r"[一-鿿]{2,10}(?:地平|沙坦|普利|洛尔|他汀|西林|霉素|环素|头孢|胶囊|注射液|颗粒|口服液|滴丸|喷雾剂)",
    ],
    "dose": [
        r"[0-9]+(?:\.[0-9]+)?\s*(?:mg/日|mg|毫克|微克|μg|ug|IU|单位|ml|毫升|克|g|片|粒|支|袋)",
        r"(?i)(?:每日\s*[一二三四1-9]\s*次|一天\s*[一二三四1-9]\s*次|\b(?:bid|tid|qid|qd|po|iv|im)\b|皮下注射\s*[0-9])",
    ],
    "absolute": r"(?:你(?:患|得)了|可以确诊|肯定是|一定是|百分之百|绝对(?:能|可以|不会)|能彻底治愈|包治|无需就医|不用去医院|不需要治疗|没救了|治不好)",
    "diagnosis": r"(?:诊断为|确诊为)",
    "safe": ["不能", "无法", "须", "需", "应由"],
    "disclaimer": "不能替代执业医师",
    "particles": ("加", "用", "服", "吃", "喝", "和", "与", "及", "等", "如", "若", "再", "又", "可", "应", "把", "被", "含", "给", "让", "或", "并", "同", "于", "在", "有"),
}


def check(df: DataFrame, key: str, answer: str, names: str, n_facts: str, allowed: list[str] | None = None, **rules) -> DataFrame:
    """key, kind, detail, severity: each distinct violation of an answer, of seven kinds.

    names holds the names in the answer's facts, n_facts their number; both come from facts
    under a limit.  A null answer is an empty one, which lacks its disclaimer only.  At most
    ten unknown entities of an answer count, the first ones.
    """
    r = DEFAULTS | rules
    a, known = F.coalesce(F.col(answer), F.lit("")), F.filter(F.coalesce(F.col(names), F.array().cast("array<string>")), lambda n: F.length(n) >= 2)
    every = lambda pattern, group=0: F.regexp_extract_all(a, F.lit(pattern), F.lit(group))
    parts = F.filter(F.transform(F.split(a, r"(?<=[。！？!?\n])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 12)
    uncited = F.filter(parts, lambda s: ~s.rlike(r["cite"]) & ~s.rlike(r["line"]) & F.exists(known, lambda n: F.contains(s, n)))
    numbers = F.transform(every(r["cite"], 1), lambda x: x.cast("decimal(38,0)"))
    bad = F.transform(F.filter(numbers, lambda x: (x < 1) | (x > F.col(n_facts))), lambda x: x.cast("string"))
    terms = F.transform(F.concat(*(every(p) for p in r["entity"])), lambda t: X.trim_lead(t, r["particles"]))
    ok = lambda t: F.exists(known, lambda n: F.contains(t, n) | F.contains(n, t)) | F.exists(F.array(*map(F.lit, allowed or [""])), lambda w: (w != "") & F.contains(t, w))
    unknown = F.slice(F.array_distinct(F.filter(terms, lambda t: ~ok(t))), 1, 10)
    doses = F.transform(F.concat(*(every(p) for p in r["dose"])), lambda x: F.trim(x))
    # a safe word within the twelve characters before takes the claim back
    before = "".join(f"(?<!{w}.{{0,{12 - len(w)}}})" for w in r["safe"])
    found = {"missing_citation": F.transform(uncited, lambda s: X.truncate(s, 40)), "invalid_citation": bad, "unknown_entity": unknown, "dose_violation": doses, "absolute_claim": every(r["absolute"]), "diagnostic_claim": every("(?s)" + before + r["diagnosis"]), "missing_disclaimer": F.when(F.contains(a, F.lit(r["disclaimer"])), F.array().cast("array<string>")).otherwise(F.array(F.lit("")))}
    of = lambda k, v: F.transform(F.array_distinct(v), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("detail"), F.lit(SEVERITY[k]).alias("severity")))
    rows = F.flatten(F.array(*(of(k, v) for k, v in found.items())))
    return df.select(key, F.inline(rows))


def verdict(violations: DataFrame, key: str) -> DataFrame:
    """key, n, score and the action: fall back, rewrite or accept."""
    got = violations.groupBy(key).agg(F.count("*").alias("n"), F.sum(lookup(SEVERITY_COST, F.col("severity"), 0.02)).alias("c"), F.max(F.col("severity") == "critical").alias("worst"), F.max(F.col("severity") == "high").alias("high"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("c"))), 3)
    action = F.when(F.col("worst") | (score < 0.45), "fallback_template").when(F.col("high") | (score < 0.75), "rewrite").otherwise("accept")
    return got.select(key, "n", score.alias("score"), action.alias("action"))


def context_text(facts: DataFrame, by: str, headings: dict[str, str], pad: int = 38) -> DataFrame:
    """by and text: ranked facts (k, head, rel, tail, confidence, part) as lines under their part's heading.

    The part `primary` comes first, others by their first number.  facts hold top-k facts of each group.
    """
    line = F.concat(F.lit("[KG-"), F.col("k"), F.lit("] "), F.col("head"), F.lit(" —"), F.col("rel"), F.lit("→ "), F.col("tail"))
    padded = F.rpad(line, F.greatest(F.lit(pad), F.length(line) + 2), F.lit(" "))
    text = F.concat(padded, F.lit("（置信度 "), F.format_string("%.2f", F.col("confidence")), F.lit("）"))
    place = F.when(F.col("part") == "primary", 0).otherwise(F.min("k").over(Window.partitionBy(by, "part")))
    first = F.row_number().over(Window.partitionBy(by, "part").orderBy("k")) == 1
    lines = F.when(first, F.concat(F.lit("\n■ "), lookup(headings, F.col("part"), ""), F.lit("\n\n"), text)).otherwise(text)
    got = facts.select(by, F.struct(place.alias("place"), "k", lines.alias("line")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = F.concat(F.lit("【知识图谱事实 —— 共 "), F.size("x"), F.lit(" 条，编号与回答中的 [KG-n] 引用一一对应】\n"))
    return got.select(by, F.concat(head, F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("text"))


def link_score(score: Column, degree: Column, start: Column, length: Column, kind: Column) -> Column:
    """A mention's score with what its node's degree, its place in the text and its type add, 0.999 at most."""
    bonus = F.least(F.lit(0.06), F.coalesce(degree, F.lit(0)) / 400.0) + F.when(start <= length * 0.5, 0.05).otherwise(0.0)
    return F.least(F.lit(0.999), score + bonus + lookup({"Disease": 0.04, "Symptom": 0.02, "Department": 0.01, "Drug": 0.01}, kind, 0.0))


def best_match(queries: DataFrame, candidates: list[str], least: float = 0.55) -> DataFrame:
    """text, match, score: the candidate most like each text, the earliest among equals; null and 0 below `least`."""
    table = queries.sparkSession.createDataFrame([(i, c) for i, c in enumerate(candidates)], "place int, candidate string")
    each = queries.select("text").distinct().crossJoin(F.broadcast(table)).withColumn("score", X.similarity(F.col("text"), F.col("candidate")))  # a parameter table
    best = each.groupBy("text").agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "candidate")).alias("m"))
    near = -F.col("m.s") >= least
    return best.select("text", F.when(near, F.col("m.candidate")).alias("match"), F.when(near, -F.col("m.s")).otherwise(0.0).alias("score"))


def sealed(c: Column, key: Column) -> Column:
    """A field (a list joined by semicolons) encrypted, marked by enc: so that it isn't sealed twice; empty ones stay."""
    return F.when(c.startswith("enc:") | (c == ""), c).otherwise(F.concat(F.lit("enc:"), X.encrypted(c, key)))


def opened(c: Column, key: Column) -> Column:
    return F.when(c.startswith("enc:"), X.decrypted(F.substring(c, 5, 1 << 30), key)).otherwise(c)


def allowed_health(df: DataFrame, key: str, numeric: list[str], enums: list[str], flags: list[str], lists: list[str]) -> DataFrame:
    """key and the allowed fields alone: numbers, words of letters (else empty), flags, and lists of at most 20 entries of 30 characters."""
    word = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z_]{2,20}\z"), F.col(c)).when(F.col(c).isNotNull(), "")
    short = lambda c: F.transform(F.slice(c, 1, 20), lambda x: F.substring(x, 1, 30))
    return df.select(key, *numeric, *(word(c).alias(c) for c in enums), *(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in flags), *(short(c).alias(c) for c in lists))


#: What a risk factor is called, with its value.
FACTOR_LABELS = {"age": "年龄 %.0f 岁", "male": "男性", "bmi": "BMI %.1f", "systolic_bp": "收缩压 %.0f mmHg", "diastolic_bp": "舒张压 %.0f mmHg", "fasting_glucose": "空腹血糖 %.1f mmol/L", "total_cholesterol": "总胆固醇 %.1f mmol/L", "ldl": "低密度脂蛋白 %.1f mmol/L", "hdl": "高密度脂蛋白 %.1f mmol/L", "triglycerides": "甘油三酯 %.1f mmol/L", "heart_rate": "心率 %.0f 次/分", "smoking": "吸烟", "drinking": "饮酒", "family_history": "家族史（命中 %.0f 项）", "symptom_score": "症状负担（评分 %.1f）", "low_activity": "缺乏规律运动"}


def factor_label(feature: Column, value: Column) -> Column:
    """A factor's label; a feature without one is its own label."""
    out = feature
    for name, form in FACTOR_LABELS.items():
        out = F.when(feature == name, F.format_string(form, value.cast("double")) if "%" in form else F.lit(form)).otherwise(out)
    return out


def evidence_chain(facts: DataFrame, *sources: tuple[DataFrame, list[str]], most: int = 3) -> DataFrame:
    """facts with refs: the first `most` references of the first source that has any for the fact's key, and which source that is.

    A source is a frame with its key columns and `ref`; references are ranked before they are gathered.
    """
    out, refs = facts, []
    for i, (frame, key) in enumerate(sources):
        k = F.row_number().over(Window.partitionBy(*key).orderBy("ref"))
        top = frame.select(*key, "ref").distinct().withColumn("k", k).where(F.col("k") <= most)
        out = out.join(top.groupBy(*key).agg(F.array_sort(F.collect_list("ref")).alias(f"_r{i}")), key, "left")
        refs.append(f"_r{i}")
    level = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(i + 1)) for i, c in enumerate(refs)), F.lit(0))
    return out.select(*facts.columns, F.coalesce(*refs, F.array()).alias("refs"), level.alias("level"))
