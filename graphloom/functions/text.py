"""Column functions over text; the one Python function is isolated at the end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms U+FF01 to U+FF5E and the ideographic space, to ASCII.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def normalize(c: Column) -> Column:
    """Full-width to half-width, white space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _WIDE, _NARROW), r"(?U)\s+", " "))


def clean_html(c: Column) -> Column:
    """Text without tags, links, addresses and reference marks, normalised."""
    for pattern in (r"<[^>]+>", r"https?://[^\s]+", r"[^\s]+@[^\s]+\.[^\s]+", r"\[[ ]*[0-9]+(?:[ ]*[-,][ ]*[0-9]+)*[ ]*\]"):
        c = F.regexp_replace(c, pattern, " ")
    return normalize(c)


def clean_punct(c: Column) -> Column:
    """Runs of characters that are no letter, digit or underscore give way to one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_]+", " "))


#: What cleaning removes, in order; the next two are superscripts and control characters.
REMOVALS = [
    r"<[^>]+>", r"(?i)(?:function|var|let|const|window\.|document\.)\s*[\p{L}\p{N}_]*", r"https?://[^\s]+", r"[^\s]+@[^\s]+\.[^\s]+",
    r"(?i)(?:版权所有|Copyright|©|\(c\)\s*20[0-9][0-9]|京ICP备)[^\s]*", r"\[\s*[0-9]+(?:\s*[-,]\s*[0-9]+)*\s*\]",
]
SUPERSCRIPTS, CONTROL = r"[\u00b9\u00b2\u00b3\u2070-\u209f]", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def clean_text(c: Column) -> Column:
    """Text without tags, script words, links, addresses, notices, reference marks, superscripts and control characters, normalised, repeated marks once."""
    c = F.coalesce(c, F.lit(""))
    for pattern in REMOVALS:
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(F.regexp_replace(c, SUPERSCRIPTS, ""), CONTROL, " ")
    return F.trim(F.regexp_replace(normalize(c), r"([。！？；，、])\1+", "$1"))


def normalize_terms(c: Column, aliases: dict[str, str]) -> Column:
    """Aliases replaced by their terms one after the other, the longest first (ties by code point), so an output may be replaced again."""
    for alias in sorted(aliases, key=lambda a: (-len(a), a)):
        c = F.replace(c, F.lit(alias), F.lit(aliases[alias]))
    return c


def trim_lead(c: Column, particles: tuple[str, ...], most: int = 2) -> Column:
    """The term without leading particles, `most` of them at most, while more than two characters are left."""
    for _ in range(most):
        c = F.when((F.length(c) > 2) & F.substring(c, 1, 1).isin(*particles), F.substring(c, F.lit(2), F.length(c))).otherwise(c)
    return c


def clean_name(c: Column) -> Column:
    """A title without brackets and page suffixes, at most 40 characters."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[（(].*?[)）]", "")
    return F.substring(F.trim(F.regexp_replace(c, r"(?:的症状|是什么|简介|概述|-医学百科| - 医学百科)\z", "")), 1, 40)


def chain_text(first: Column, steps: Column) -> Column:
    """A path as text: the first node, then relation and node of each step (array of structs relation, to)."""
    return F.concat_ws(" ", first, F.array_join(F.transform(steps, lambda s: F.concat(F.lit("—"), s["relation"], F.lit("→ "), s["to"])), " "))


def truncate(c: Column, n: int = 60, tail: str = "…") -> Column:
    c = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit(tail)))


def sentences(c: Column) -> Column:
    """Parts that end with a sentence mark or line end, mark kept, trimmed, none empty."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[。！？；!?;.\n])")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def char_ngrams(c: Column, n: int = 2) -> Column:
    """Sliding windows of n characters of the text without white space; a shorter text is its own window."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    windows = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(F.length(t) >= n, windows).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def masked_email(c: Column) -> Column:
    return F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "EMAIL_MASKED")


def pseudonym(seed: Column, salt: str) -> Column:
    return F.concat(F.lit("anon_"), F.substring(F.sha2(F.concat(F.lit(salt + ":"), seed), 256), 1, 16))


def encrypted(c: Column, key: Column) -> Column:
    """AES-GCM as ``v1:nonce:ciphertext and tag``, each base64."""
    # bound once: two evaluations would draw two nonces
    join = lambda raw: F.concat(F.lit("v1:"), F.base64(F.substring(raw, 1, 12)), F.lit(":"), F.base64(F.substring(raw, 13, 1 << 30)))
    return F.element_at(F.transform(F.array(F.aes_encrypt(c, key, F.lit("GCM"))), join), 1)


def decrypted(c: Column, key: Column) -> Column:
    """The text, or null for a changed token or another key."""
    part = F.split(c, ":")
    return F.try_aes_decrypt(F.concat(F.unbase64(part[1]), F.unbase64(part[2])), key, F.lit("GCM")).cast("string")


def tier_similarity(a: Column, b: Column) -> Column:
    """Similarity where no alignment is needed: 1 if equal, 0.82 to 0.98 if one holds the other, else null."""
    a, b = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) | (lb == 0), F.lit(0.0)).when(a == b, F.lit(1.0)).when(F.contains(a, b) | F.contains(b, a), 0.82 + 0.16 * F.least(la, lb) / F.greatest(la, lb))


def similarity(a: Column, b: Column) -> Column:
    """tier_similarity, and the matching-blocks ratio for the rest (no built-in function equals it)."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p.strip(), q.strip()).ratio() if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="float64")

    tier = tier_similarity(a, b)
    # rows that the tiers settle reach the function as nulls and cost nothing there
    return F.coalesce(tier, ratio(F.when(tier.isNull(), a), F.when(tier.isNull(), b)))
