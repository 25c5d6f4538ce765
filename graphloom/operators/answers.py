"""What surrounds an answer: follow-up questions, the main entity, template lookup, chat text, HTML, fuzzy mentions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def follow_ups(edges: DataFrame, templates: dict[str, list[str]], defaults: list[str], n: int = 5) -> DataFrame:
    """id and questions: templates of the entity's relations, by each relation's first edge, then defaults; distinct, n at most.

    A group holds one row a relation with templates, so its size is that of the parameter.
    """
    ends = edges.select(F.col("source").alias("id"), "rel", "seq").unionByName(edges.select(F.col("target").alias("id"), "rel", "seq"))
    first = ends.where(F.col("rel").isin(list(templates))).groupBy("id", "rel").agg(F.min("seq").alias("seq"))
    asked = F.create_map(*[x for rel, qs in templates.items() for x in (F.lit(rel), F.array(*map(F.lit, qs)))])
    rels = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "rel"))).alias("rels"))
    own = F.transform(F.flatten(F.transform("rels", lambda r: asked[r["rel"]])), lambda q: F.replace(q, F.lit("{e}"), F.col("id")))
    return rels.select("id", F.slice(F.array_distinct(F.concat(own, F.array(*map(F.lit, defaults)))), 1, n).alias("questions"))


def main_entity(facts: DataFrame, group: str, head: str, seq: str) -> DataFrame:
    """Of each group the head with most facts, the one seen first among equals; counts combine before the shuffle."""
    counts = facts.groupBy(group, head).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    best = F.max_by(F.struct(head, "n"), F.struct("n", F.negative(F.col("first.l_orderkey")), F.negative(F.col("first.l_linenumber")), head))
    return counts.groupBy(group).agg(best.alias("best")).select(group, "best.*")


def with_keyword(templates: DataFrame, keyword: str, fields: list[str], tags: str) -> DataFrame:
    """Templates that hold the keyword, in any case, in one of the fields or in a tag."""
    k = keyword.lower()
    hit = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit(k)))
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(k))
    return templates.where(F.coalesce(hit, F.lit(False)))


def chat_text(system: Column, user: Column, extra: Column, answer: Column) -> Column:
    """One training text of a system line, a question with its extra input, and an answer, each under its header."""
    question = F.concat(user, F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("\n\nAlso: "), extra)).otherwise(""))
    parts = [F.concat(F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n"), F.coalesce(c, F.lit("")), F.lit("<|eot_id|>")) for role, c in (("system", system), ("user", question), ("assistant", answer))]
    return F.concat(F.lit("<|begin_of_text|>"), *parts)


#: Characters that HTML escapes, ampersand first, and Markdown marks with their HTML.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
MARKS = [(r"(?dm)^### (.+)$", "<h5>$1</h5>"), (r"(?dm)^## (.+)$", "<h4>$1</h4>"), (r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\n", "<br/>"), (r"\[KG-([0-9]+)\]", '<sup class="kg-cite" data-cite="KG-$1">[KG-$1]</sup>')]


def markdown_html(c: Column) -> Column:
    """Headings, bold, line ends and citation marks as HTML; everything else escaped."""
    c = F.coalesce(c, F.lit(""))
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    for a, b in MARKS:
        c = F.regexp_replace(c, a, b)
    return c


def confusions(rows: DataFrame, gold: str, predicted: str, top: int = 8) -> DataFrame:
    """The most frequent wrong (gold, predicted) pairs with their counts, beside the accuracy over all rows."""
    pairs = rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))
    share = pairs.agg((F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    wrong = pairs.where(F.col(gold) != F.col(predicted)).orderBy(F.desc("n"), gold, predicted).limit(top)
    return wrong.crossJoin(F.broadcast(share))  # one row


def similar(a: str, b: str, least: float) -> float:
    """Similarity of two trimmed texts if it is `least` or more, else 0; cheap upper bounds spare most alignments."""
    from difflib import SequenceMatcher

    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        s = 0.82 + 0.16 * min(len(a), len(b)) / max(len(a), len(b))
    else:
        m = SequenceMatcher(None, a, b)
        s = m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0
    return s if s >= least else 0.0


def _possible(codes: np.ndarray, blank: np.ndarray, names: list[str], size: int, sums: dict[int, np.ndarray], least: float) -> np.ndarray:
    """Starts of windows that may resemble a name, by the letters they have in common; no other window does.

    Blank ends aren't part of a window.  A ratio of at least `least` needs least / 2 * (both lengths)
    common letters, and one text holds the other only if all letters of the shorter are common.
    """
    at = np.arange(len(codes))
    following = np.minimum.accumulate(np.where(blank, len(codes), at)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(blank, -1, at))
    starts = len(codes) - size + 1
    length = before[size - 1 :] - following[:starts] + 1
    fits = np.zeros(starts, bool)
    for name in names:
        common = np.zeros(starts, np.int32)
        for letter in set(name):
            c = sums[ord(letter)]
            common += np.minimum(c[size : size + starts] - c[:starts], name.count(letter))
        fits |= (2 * common >= (least - 1e-9) * (length + len(name))) | (common >= np.minimum(length, len(name)))
    return np.flatnonzero(fits & (length > 0))


#: Characters whose windows are looked at together.
TOGETHER = 300_000


def fuzzy_mentions(docs: DataFrame, key: str, text: str, names: list[str], lengths: tuple[int, ...] = (8, 7, 6, 5, 4, 3, 2), least: float = 0.72, factor: float = 0.85) -> DataFrame:
    """Windows of whole texts that resemble a name: for each length, longest first, the first window free of earlier hits.

    Columns: key, start, end, name (the most similar, the first among equals) and score (similarity times factor).
    Names are a parameter; a null or empty text has no mention.  Windows of many texts are sifted at
    once by the letters that they share with a name, and only what is left is aligned.
    """
    names = [n for n in (x.strip() for x in names) if n]

    def some(pdf: pd.DataFrame) -> Iterator[list[tuple]]:
        rows, n = [], 0
        for k, t in zip(pdf["k"], pdf["t"], strict=True):
            if t:
                rows.append((k, t))
                n += len(t)
            if n > TOGETHER:
                yield rows
                rows, n = [], 0
        yield rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[str, float]] = {}
        for pdf in batches:
            out = []
            for rows in some(pdf) if names else ():
                codes = np.frombuffer("".join(t for _, t in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
                kinds, which = np.unique(codes, return_inverse=True)
                blank = np.array([chr(x).isspace() for x in kinds], bool)[which]
                sums = {ord(c): np.concatenate([[0], np.cumsum(codes == ord(c), dtype=np.int32)]) for c in {c for n in names for c in n}}
                ends = np.cumsum([0] + [len(t) for _, t in rows])
                cuts = {}
                for size in lengths:
                    if len(codes) >= size:
                        found = _possible(codes, blank, names, size, sums, least)
                        cuts[size] = (found, np.searchsorted(found, ends))
                for j, (k, t) in enumerate(rows):
                    taken: list[tuple[int, int]] = []
                    for size in lengths:
                        if len(t) < size:
                            continue
                        found, cut = cuts[size]
                        for i in (found[cut[j] : cut[j + 1]] - ends[j]).tolist():
                            # the last windows reach into the next text
                            if i + size > len(t):
                                break
                            if any(i < e and s < i + size for s, e in taken):
                                continue
                            part = t[i : i + size].strip()
                            if part not in memo:
                                if len(memo) > 200_000:
                                    memo.clear()
                                memo[part] = max(((n, similar(part, n, least)) for n in names), key=lambda x: x[1], default=("", 0.0))
                            name, s = memo[part]
                            if s:
                                taken.append((i, i + size))
                                out.append((k, i, i + size, name, round(s * factor, 4)))
                                break
            yield pd.DataFrame(out, columns=["k", "start", "end", "name", "score"])

    kind = "k string, start int, end int, name string, score double"
    found = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, kind)
    return found.withColumnRenamed("k", key)


def first_named(text: Column, names: list[str], size: int = 200) -> Column:
    """The first of the names, in their order, that the head of the text holds; null where none does."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, size)
    return F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(head, n)), F.lit(1))


def select_template(questions: DataFrame, templates: DataFrame, key: list[str], text: str) -> DataFrame:
    """key and the id of the first template (by place) of the question's intent whose length bounds and words fit.

    templates: intent, place, id, min_len and max_len (0 or null: no bound), keyword_any (null or empty: no condition);
    a question without a fitting template gets null.
    """
    n = F.length(F.coalesce(text, F.lit("")))
    fits = (F.coalesce("min_len", F.lit(0)) == 0) | (n >= F.col("min_len"))
    fits &= (F.coalesce("max_len", F.lit(0)) == 0) | (n <= F.col("max_len"))
    fits &= (F.coalesce(F.size("keyword_any"), F.lit(0)) <= 0) | F.exists("keyword_any", lambda k: F.contains(F.coalesce(text, F.lit("")), k))
    joined = questions.join(templates, "intent", "left")
    return joined.groupBy(*key).agg(F.min_by(F.when(fits, F.col("id")), F.when(fits, F.col("place"))).alias("id"))


def viterbi(emissions: Column, start: list[float], transitions: list[list[float]], end: list[float]) -> Column:
    """The best tag numbers of a sequence of emission rows; ties go to the lower number, an empty sequence has none.

    A fold inside generated code; it carries a path for each tag, so it suits sentences, not whole books.
    """
    tags = range(len(start))
    row = lambda xs: F.array(*map(F.lit, xs))
    first = F.struct(F.zip_with(row(start), emissions[0], lambda a, b: a + b).alias("score"), F.array(*(F.array(F.lit(j)) for j in tags)).alias("path"))

    def best(score: Column, into: list[float]) -> Column:
        return F.array_max(F.array(*(F.struct((score[i] + into[i]).alias("s"), F.lit(-i).alias("k")) for i in tags)))

    def step(acc: Column, e: Column) -> Column:
        came = F.array(*(best(acc["score"], [transitions[i][j] for i in tags]) for j in tags))
        score = F.zip_with(came, e, lambda c, x: c["s"] + x)
        path = F.transform(came, lambda c, j: F.concat(acc["path"][F.negative(c["k"])], F.array(j)))
        return F.struct(score.alias("score"), path.alias("path"))

    done = F.aggregate(F.slice(emissions, 2, 1 << 30), first, step, lambda acc: acc["path"][F.negative(best(acc["score"], end)["k"])])
    return F.when(F.size(emissions) > 0, done).otherwise(F.array().cast("array<int>"))


#: The order of an answer's sections; other relations follow by name.
SECTIONS = ["症状", "治疗", "用药", "检查", "科室", "并发症", "鉴别诊断", "易感人群", "相关（多跳推理）", "相关"]
#: What stands at the end of every answer.
DISCLAIMER = "本回答由 AI 生成，仅供参考，不能替代执业医师诊断。"
NOTHING = "当前知识库暂未检索到与该问题直接相关的图谱事实，为避免误导，本系统不做推测性回答。"


def _section(label: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), label)
    return F.when(place > 0, place).otherwise(len(SECTIONS) + 1)


def _joined(lines: DataFrame, by: str, order: list[str], sep: str) -> DataFrame:
    """by and text: the lines in order; a question has no more lines than facts."""
    return lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("l")).select(by, F.array_join(F.transform("l", lambda x: x["line"]), sep).alias("text"))


def _framed(body: DataFrame, asked: DataFrame, by: str, title: Column, nothing: Column) -> DataFrame:
    """Every question's answer: its title, its body or that nothing was found, and the disclaimer."""
    whole = asked.select(by).distinct().join(body, by, "left")
    return whole.select(by, F.concat_ws("\n\n", title, F.coalesce("text", nothing), F.lit(DISCLAIMER)).alias("answer"))


def slot_answer(facts: DataFrame, asked: DataFrame, by: str, sentences: dict[str, str]) -> DataFrame:
    """An answer by relation: a section each in the fixed order, its sentence with the distinct tails and their evidence.

    facts: by, label, tail, n (rank), evidence; sentences: text with {items} by label.
    """
    first = facts.where(F.trim("tail") != "").groupBy(by, "label", F.trim("tail").alias("tail")).agg(F.min(F.struct("n", "evidence")).alias("m"))
    items = first.select(by, "label", F.col("m.n").alias("n"), F.concat("tail", F.coalesce(F.concat(F.lit(" ["), F.nullif("m.evidence", F.lit("")), F.lit("]")), F.lit(""))).alias("line"))
    each = _joined(items.withColumn("by", F.struct(by, "label")), "by", ["n"], "、").select(f"by.{by}", "by.label", "text")
    said = F.lit("{items}。")
    for label, text in sentences.items():
        said = F.when(F.col("label") == label, F.lit(text)).otherwise(said)
    lines = each.select(by, _section(F.col("label")).alias("place"), "label", F.concat(F.lit("### "), "label", F.lit("\n- "), F.replace(said, F.lit("{items}"), F.col("text"))).alias("line"))
    return _framed(_joined(lines, by, ["place", "label"], "\n\n"), asked, by, F.concat(F.lit("## 基于知识图谱的回答（主实体："), F.col(by), F.lit("）")), F.lit(NOTHING))


def fallback_answer(facts: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """The answer that replaces a rejected one: every fact as it stands, by relation."""
    fact = F.concat(F.lit("- "), "head", F.lit(" —"), "label", F.lit("→ "), "tail", F.coalesce(F.concat(F.lit(" ["), F.nullif("evidence", F.lit("")), F.lit("]")), F.lit("")))
    each = _joined(facts.select(F.struct(by, "label").alias("by"), "n", fact.alias("line")), "by", ["n"], "\n").select(f"by.{by}", "by.label", "text")
    lines = each.select(by, _section(F.col("label")).alias("place"), "label", F.concat(F.lit("### "), "label", F.lit("\n"), "text").alias("line"))
    return _framed(_joined(lines, by, ["place", "label"], "\n\n"), asked, by, F.lit("## 基于知识图谱的安全回答（已启用降级模式）"), F.lit(NOTHING))


def graph_answer(facts: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """An answer of facts alone, relations in the order of their first fact."""
    line = F.concat(F.lit("- "), "tail", F.lit(" [KG-"), "n", F.lit("]"))
    each = facts.groupBy(by, "label").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    lines = each.select(by, "n", F.concat(F.lit("### "), "label", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("line"))
    return _framed(_joined(lines, by, ["n"], "\n\n"), asked, by, F.concat(F.lit("## "), F.col(by), F.lit(" 相关知识（来自知识图谱）")), F.lit(NOTHING))


#: Leading verbs that only read, and words that write.
READING, WRITING = r"(?is)^\s*(?:match|optional\s+match|unwind|with|return|show|call)\b", r"(?i)\b(?:create|merge|set|delete|detach|remove|drop|load\s+csv|foreach)\b"


def template_verdict(text: Column, allowed: list[str]) -> Column:
    """'ok', or why a graph template may not run: it writes, names a label or relation that isn't allowed, or has neither a limit nor a count."""
    bare = F.regexp_replace(text, r"\[\s*\*\s*[0-9]*\s*(?:\.\.\s*[0-9]+\s*)?\]", "[]")
    names = F.regexp_extract_all(bare, F.lit(r":\s*([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    strange = F.array_except(names, F.array(*map(F.lit, allowed)))
    low = F.lower(text)
    writes = ~F.coalesce(text.rlike(READING), F.lit(False)) | text.rlike(WRITING)
    return F.when(writes, "not read-only").when(F.size(strange) > 0, F.concat(F.lit("not allowed: "), F.array_join(F.array_sort(strange), ","))).when(~low.contains("limit") & ~low.contains("count("), "no limit").otherwise("ok")


def input_status(asked: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """asked with status: 'empty', 'unknown' (no node of that name, without case) or 'ok', and a message but for the last."""
    name = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    known = nodes.select(F.lower(F.trim("name")).alias("_name")).distinct().withColumn("_known", F.lit(True))
    got = asked.withColumn("_name", name).join(known, "_name", "left")
    status = F.when(F.col("_name") == "", "empty").when(F.col("_known").isNull(), "unknown").otherwise("ok")
    message = F.when(F.col("_name") == "", "请输入实体名称").when(F.col("_known").isNull(), F.concat(F.lit("未找到实体："), F.trim(F.col(text))))
    return got.select(*asked.columns, status.alias("status"), message.alias("message"))


def template_stats(templates: DataFrame) -> DataFrame:
    """Templates (id, intent) by intent, and in all (a null intent)."""
    each = templates.groupBy("intent").agg(F.count("*").alias("n"))
    return each.unionByName(each.agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("intent"), "n"))


def missing_templates(templates: DataFrame, required: DataFrame) -> DataFrame:
    """Required ids that no template has."""
    return required.select("id").distinct().join(templates.select("id"), "id", "left_anti")
