"""Column functions of the service edge: durations, templates, snippets, id sequences, checks of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def since_days(c: Column) -> Column:
    """A duration like 1d, 12h or 30m as whole days, rounded up, one at least; null where it isn't one."""
    n, unit = F.regexp_extract(c, r"^\s*([0-9]+)\s*([dhm])\s*$", 1), F.regexp_extract(c, r"^\s*([0-9]+)\s*([dhm])\s*$", 2)
    per = F.when(unit == "d", 1.0).when(unit == "h", 24.0).when(unit == "m", 1440.0)
    return F.greatest(F.lit(1), F.ceil(F.when(n != "", n).cast("double") / per)).cast("long") * F.when(n != "", 1)


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """{name} placeholders replaced, those left over removed."""
    full = reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)
    return F.regexp_replace(full, r"\{[a-z_]+\}", "")


def snippet(text: Column, words: list[str], before: int = 40, size: int = 200) -> Column:
    """`size` characters from `before` ahead of the earliest word, with ellipses where text is cut."""
    places = [F.when(F.instr(text, w) > 0, F.instr(text, w)) for w in words]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1))
    start = F.greatest(F.lit(1), first - before)
    body = F.substring(text, start, F.lit(size))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + size <= F.length(text), "…").otherwise(""))


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The id of the first rule one of whose words the text holds."""
    out = None
    for name, words in rules:
        hit = reduce(lambda a, b: a | b, (text.contains(w) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def reject_reason(ranges: dict[str, tuple[float, float]]) -> Column:
    """The first named column outside its range, or ok; nulls pass."""
    out = None
    for name, (low, high) in ranges.items():
        bad = F.col(name).isNotNull() & ~F.col(name).between(low, high)
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out.otherwise("ok")


def char_ids(text: Column, alphabet: str, size: int) -> Column:
    """Ids of the first `size` characters (place in the alphabet from 2; 1 for others), padded with 0."""
    chars = F.filter(F.split(F.substring(text, 1, size), ""), lambda x: x != "")
    ids = F.transform(chars, lambda x: F.when(F.instr(F.lit(alphabet), x) > 0, F.instr(F.lit(alphabet), x) + 1).otherwise(1))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), size)), 1, size)
