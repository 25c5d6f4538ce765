"""Triples from prose by trigger patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relation, pattern whose first group holds the tails, and confidence.
RULES = [
    ("HAS_SYMPTOM", r"(?:表现为|症状(?:为|有|包括)?|主要症状是|可出现|伴有|伴随)[:：]?\s*([^。；;\n]{2,120})", 0.9),
    ("TREATED_BY", r"(?:治疗(?:方法|方案|原则|手段)?(?:为|是|包括|以)?|给予|予以|采用|首选)[:：]?\s*([^。；;\n]{2,120})", 0.88),
    ("USES_DRUG", r"(?:常用|使用|服用|口服|应用|给予)\s*([一-鿿]{2,10}(?:、[一-鿿]{2,10})*)\s*(?:等)?(?:药物|药)", 0.86),
    ("BELONGS_TO", r"(?:就诊(?:于)?|挂号|属于|归|首诊)\s*([一-鿿]{2,12}科)", 0.95),
    ("NEEDS_CHECK", r"(?:需行|应行|检查(?:包括|为)?|辅助检查(?:包括)?|可行)[:：]?\s*([^。；;\n]{2,120})", 0.88),
    ("HAS_COMPLICATION", r"(?:并发|可导致|可引起|易并发)\s*([一-鿿]{2,20}(?:、[一-鿿]{2,20})*)", 0.84),
    ("DIFFERENTIAL_WITH", r"(?:需与|应与|鉴别诊断(?:包括)?|鉴别)\s*([^。；;\n]{2,80})", 0.82),
]
#: What separates tails, what is cut off around a list and around a tail, relations whose tails are short.
SEPARATORS, AROUND_LIST, AROUND_TAIL, SHORT = r"[、,，/和及与]", " 　:：，,。;；", " 　:：。;；", ("HAS_SYMPTOM", "TREATED_BY")


def _tails(text: Column, rel: str, pattern: str, separators: str) -> Column:
    """The tails of all matches of a rule: 2 to 30 characters (24 for SHORT), not numbers alone."""
    lists = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(1)), lambda s: F.btrim(s, F.lit(AROUND_LIST)))
    parts = F.transform(F.flatten(F.transform(lists, lambda s: F.split(s, separators))), lambda p: F.btrim(p, F.lit(AROUND_TAIL)))
    return F.filter(parts, lambda p: F.length(p).between(2, 24 if rel in SHORT else 30) & ~p.rlike(r"(?U)^[\d.%\s~-]+\z"))


def _triple(tail: Column, rel: str, base: float, words: list[str], bonus: float) -> Column:
    known = F.lit(False)
    for w in words:
        known = known | F.contains(tail, F.lit(w))
    confidence = F.when(known, min(round(base + bonus, 4), 0.99)).otherwise(min(base, 0.99))
    return F.struct(F.lit(rel).alias("rel"), tail.alias("tail"), confidence.alias("confidence"))


def pattern_triples(docs: DataFrame, keys: list[str], text: str, rules: list[tuple[str, str, float]] | None = None, lexicon: dict[str, list[str]] | None = None, separators: str = SEPARATORS, bonus: float = 0.05) -> DataFrame:
    """keys, rel, tail and confidence, each triple of a row once.

    A tail that holds a word of its relation's lexicon gains `bonus`, 0.99 at most.  One pass
    over the text, no shuffle; a null or empty text has no triples.
    """
    chosen, words = RULES if rules is None else rules, lexicon or {}
    text = F.coalesce(text, F.lit(""))
    per_rule = [F.transform(_tails(text, rel, pattern, separators), lambda t: _triple(t, rel, base, words.get(rel, []), bonus)) for rel, pattern, base in chosen]
    return docs.select(*keys, F.explode(F.array_distinct(F.concat(*per_rule))).alias("_t")).select(*keys, "_t.*")
