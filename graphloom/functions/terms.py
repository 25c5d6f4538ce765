"""Column functions over words of a lexicon: tokens, classes of keywords, attention weights, domain questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize

#: Words that carry no meaning in a question.
STOP_WORDS = ["的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "会", "着", "没有", "看", "好", "自己", "这", "那", "什么", "怎么", "如何", "哪些", "请问", "一下", "可以", "需要", "应该", "吗", "呢", "吧", "啊", "呀", "帮我", "想知道", "了解", "关于", "对于"]
#: Fixed value: questions of the domain that name none of its terms.
ASKS = r"挂(?:什么|哪个|哪)科|看(?:什么|哪个|哪)科|怎么(?:治|办)|如何(?:治|预防)|吃什么药|用(?:什么|哪些)药|能(?:治好|治愈|根治)|严重吗|要紧吗|危险吗|会不会(?:传染|遗传|有事)|需要(?:手术|住院|检查)|挂[内外妇儿皮眼口耳]|看[内外妇儿皮眼口耳]"
#: Stands for a character that a word has taken; of the private use area.
TAKEN = "\ue000"


def tokens(c: Column, script: str = "一-鿿", stop: list[str] | None = None) -> Column:
    """The characters of the script, then their neighbouring pairs, without stop words.

    Pairs join characters that other scripts stood between, as those are dropped first.
    """
    one = F.regexp_extract_all(normalize(c), F.lit(f"[{script}]"), F.lit(0))
    n = F.greatest(F.lit(0), F.size(one) - 1)
    two = F.zip_with(F.slice(one, F.lit(1), n), F.slice(one, F.lit(2), n), lambda a, b: F.concat(a, b))
    words = STOP_WORDS if stop is None else stop
    return F.filter(F.concat(one, two), lambda w: ~w.isin(words))


def _longest(words: list[str]) -> list[str]:
    return sorted(set(words), key=lambda w: (-len(w), w))


def keyword_state(c: Column, lexicon: dict[str, list[str]]) -> Column:
    """t and hits (class, word, n): the text with matched characters marked, and how often each word matched.

    Classes go in their order, a class's words longest first; no match takes a character that
    an earlier one has.  One fold over the lexicon, so an expression of its size.
    """
    every = [F.struct(F.lit(k).alias("class"), F.lit(w).alias("word")) for k, ws in lexicon.items() for w in _longest(ws)]
    empty = F.array().cast("array<struct<class:string,word:string,n:int>>")
    start = F.struct(F.coalesce(c, F.lit("")).alias("t"), empty.alias("hits"))

    def step(s: Column, w: Column) -> Column:
        rest = F.replace(s["t"], w["word"], F.repeat(F.lit(TAKEN), F.length(w["word"])))
        n = ((F.length(s["t"]) - F.length(F.replace(s["t"], w["word"], F.lit("")))) / F.length(w["word"])).cast("int")
        hit = F.struct(w["class"].alias("class"), w["word"].alias("word"), n.alias("n"))
        return F.struct(rest.alias("t"), F.concat(s["hits"], F.when(n > 0, F.array(hit)).otherwise(empty)).alias("hits"))

    return F.aggregate(F.array(*every), start, step)


def keyword_class(hits: Column, lexicon: dict[str, list[str]], default: str = "symptom") -> Column:
    """The class with most matched characters, the earlier class among equals; a default without matches."""
    def of(k: str) -> Column:
        return F.aggregate(F.filter(hits, lambda h: h["class"] == k), F.lit(0), lambda s, h: s + h["n"] * F.length(h["word"]))

    weight = {k: of(k) for k in lexicon}
    best = F.greatest(*weight.values(), F.lit(0)) if len(weight) > 1 else next(iter(weight.values()))
    return F.coalesce(*(F.when((w == best) & (w > 0), F.lit(k)) for k, w in weight.items()), F.lit(default))


def keyword_mask(c: Column, lexicon: dict[str, list[str]], n: int) -> Column:
    """n numbers: 1 where a keyword lies at that character of the text, else 0."""
    marks = F.regexp_extract_all(F.substring(keyword_state(c, lexicon)["t"], 1, n), F.lit("(?s)."), F.lit(0))
    at = F.transform(marks, lambda x: F.when(x == TAKEN, 1.0).otherwise(0.0))
    return F.concat(at, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(at)))


def attention(tokens_: Column, lexicon: dict[str, list[str]], of: str | None = None, temperature: float = 1.0) -> Column:
    """A softmax weight for each token: temperature times (centrality + 1 if it holds a keyword of the class, of any where `of` is null)."""
    let = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)  # noqa: E731  # binds a value, so that it is worked out once
    words = [w for ws in lexicon.values() for w in ws] if of is None else lexicon[of]
    earlier = {} if of is None else dict(list(lexicon.items())[: list(lexicon).index(of)])
    free = lambda t: keyword_state(t, earlier)["t"] if earlier else t
    hit = lambda t: let(free(t), lambda u: reduce(lambda a, b: a | b, (F.contains(u, F.lit(w)) for w in words)))

    def raw(n: Column) -> Column:
        center = (n - 1) / 2.0
        central = lambda i: F.when(n <= 1, F.lit(0.5)).otherwise(0.6 * (1.0 - F.abs(i - center) / F.greatest(center, F.lit(1e-6))))
        return F.transform(tokens_, lambda t, i: temperature * (central(i) + F.when(hit(t), 1.0).otherwise(0.0)))

    def share(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))

    return let(let(F.greatest(F.lit(1), F.size(tokens_)), raw), lambda r: let(let(F.array_max(r), lambda top: F.transform(r, lambda x: F.exp(x - top))), share))


def of_domain(question: Column, terms: list[str], asks: str = ASKS) -> Column:
    """Whether a question holds a term of the domain or asks in one of its ways; an empty one does not."""
    q = F.trim(F.coalesce(question, F.lit("")))
    return (q != "") & (F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(q, t)) | q.rlike(asks))


def dictionary_matches(c: Column, terms: list[str]) -> Column:
    """Terms in the text, leftmost and of one place the longest, none overlapping, in the text's order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("|".join(f"\\Q{t}\\E" for t in _longest(terms))), F.lit(0))


def entity_names(*lists: Column) -> Column:
    """The distinct names of several lists in order, trimmed, none empty; a missing list counts as empty."""
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*(F.coalesce(x, none) for x in lists)))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))
