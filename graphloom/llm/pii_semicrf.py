"""Personal data by a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these
spans always stay.  Beside them a semi-Markov CRF scores whole candidate
segments (runs of tokens) by span features such as digit counts, checksum,
separators and the word before, and a dynamic program over segments of at most
MAX_TOKENS whole tokens, of any length, chooses boundaries and types jointly: a type's score
depends on that of the window's entity before it, too.  Its entities that touch no base span
are added.  An entity has a token with a mark (a
digit, an at-sign, plain or spelled out), so only the MAX_TOKENS tokens before and
after such a token are decoded: none can lie elsewhere.

Weights are fitted by conditional likelihood on windows of a bounded sample, in which base
spans, and copies of them in disguise (no plus sign, spelled-out at-sign), are the gold
entities: the partition function and the expected features of all segmentations come from
forward and backward sums over segments.

Defined cases: a null text is empty, as is an empty table's result; a text without
matches has an empty span list; a text of any length is read whole; repeated rows get
equal results; of equally good segmentations the one with the shorter last entity, and
then the earlier kind, is taken; with fewer than FEW gold entities the fixed prior
weights serve.  Offsets are code points, ends exclusive.  Only doc_id and text are read, and
redact() keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 5
#: Gold entities of a sample from which on weights are learned.
FEW = 20
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that begins inside a run of digits would have begun at the run's first digit
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, in time linear in the text: only at-signs are looked at."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1  # no local part reaches back over an at-sign
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) of all base matches by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# --- the semi-Markov CRF

#: Words that announce an entity, by kind.
CUES = {"email": {"email", "e-mail", "mail"}, "ip": {"ip", "host", "server"}, "card": {"card", "visa", "mastercard", "amex"}, "phone": {"tel", "phone", "call", "mobile", "fax"}}
_AT = re.compile(r"^[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]+)+$", re.I)
_PHONE_SHAPE = re.compile(r"^(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}$")
_CARD_SHAPE = re.compile(r"^[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?:\1[0-9]{1,3})?$|^[0-9]{14,19}$")
_OCTETS = re.compile(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")


def span_features(span: str, before: str, kind: str, tokens: int) -> list[str]:
    """Names of the binary features of a whole segment as an entity of a kind."""
    d = _digits(span)
    bucket = next(k for k, top in enumerate((0, 6, 9, 13, 15, 19, 1 << 60)) if len(d) <= top)
    out = [f"{kind}:bias", f"{kind}:digits{bucket}", f"{kind}:tokens{min(tokens, 4)}"]
    if kind == "email":
        out.append(f"email:shape{bool(_AT.match(span))}")
    elif kind == "ip":
        out.append(f"ip:shape{bool(_OCTETS.match(span)) and all(int(p) <= 255 for p in span.split('.'))}")
    elif kind == "card":
        out.append(f"card:shape{bool(_CARD_SHAPE.match(span))}luhn{bool(14 <= len(d) <= 19 and luhn(d))}")
    else:
        out.append(f"phone:shape{bool(_PHONE_SHAPE.match(span))}plus{span[:1] == '+'}")
    if before in CUES[kind]:
        out.append(f"{kind}:cue")
    return out


#: Fixed prior weights, for samples without entities to learn from.
PRIOR = {"email:shapeTrue": 6.0, "email:shapeFalse": -6.0, "ip:shapeTrue": 4.0, "ip:shapeFalse": -6.0, "card:shapeTrueluhnTrue": 6.0, "card:shapeTrueluhnFalse": -3.0, "card:shapeFalseluhnTrue": -1.0, "card:shapeFalseluhnFalse": -6.0, "phone:shapeTrueplusTrue": 5.0, "phone:shapeTrueplusFalse": 1.5, "phone:shapeFalseplusTrue": -1.0, "phone:shapeFalseplusFalse": -6.0, **{f"{k}:bias": -1.0 for k in KINDS}, **{f"{k}:cue": 1.0 for k in KINDS}}
_TRIM = ".,;:!?\"'"
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of whole tokens, as spans, each at most MAX_TOKENS tokens from one with a mark."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts, ranges, last = [a for a, _ in tokens], [], -1
    for m in _MARK.finditer(text):
        if m.start() < last:
            continue
        k = bisect_right(starts, m.start()) - 1
        last = tokens[k][1]
        a, b = max(0, k - MAX_TOKENS), min(len(tokens), k + MAX_TOKENS)
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = b
        else:
            ranges.append([a, b])
    return [tokens[a:b] for a, b in ranges]


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in _TRIM:
        b -= 1
    while b > a and text[a] in _TRIM:
        a += 1
    return a, b


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int, list[str]]]:
    """Candidate entities of a window as (first token, end token, start, end, kind's number, features), by end token, then first token, then kind."""
    marked = [bool(_MARK.search(text, a, b)) for a, b in tokens]
    out = []
    for j in range(1, len(tokens) + 1):
        for i in range(max(0, j - MAX_TOKENS), j):
            if not any(marked[i:j]):
                continue
            a, b = _trimmed(text, tokens[i][0], tokens[j - 1][1])
            if b - a < 5:  # shorter than any kind's shape
                continue
            before = text[tokens[i - 1][0] : tokens[i - 1][1]].strip(_TRIM).lower() if i else ""
            out += [(i, j, a, b, k, span_features(text[a:b], before, kind, j - i)) for k, kind in enumerate(KINDS)]
    return out


#: The state before a window's first entity, and the features of an entity's kind after the one before it.
_NONE = len(KINDS)
AFTER = [[f"{prev}>{kind}" for kind in KINDS] for prev in (*KINDS, "none")]


def decode(text: str, tokens: list[tuple[int, int]], weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """The best segmentation of a window into entities and single outside tokens (score 0): bounded-entity dynamic programming over the end and the last entity's kind."""
    n, get, low = len(tokens), weights.get, float("-inf")
    step = [[get(f, 0.0) for f in row] for row in AFTER]
    best = [[low] * (_NONE + 1) for _ in range(n + 1)]
    back: list[list] = [[None] * (_NONE + 1) for _ in range(n + 1)]
    best[0][_NONE] = 0.0
    into: dict[int, list[tuple[float, int]]] = {}  # for each kind the best state before a segment that starts here
    found, at = segments(text, tokens), 0
    for j in range(1, n + 1):
        here = best[j]
        here[:] = best[j - 1]
        while at < len(found) and found[at][1] == j:
            i, _, a, b, k, names = found[at]
            if i not in into:
                into[i] = [max((best[i][s] + step[s][q], -s) for s in range(_NONE + 1)) for q in range(len(KINDS))]
            base, prev = into[i][k]
            score = base + sum(get(f, 0.0) for f in names)
            if score > here[k]:
                here[k], back[j][k] = score, (i, a, b, -prev)
            at += 1
    out, j = [], n
    state = max(range(_NONE + 1), key=lambda s: (best[n][s], s == _NONE, -s))
    while j and state != _NONE:
        if back[j][state] is None:
            j -= 1
        else:
            i, a, b, prev = back[j][state]
            out.append((a, b, state))
            j, state = i, prev
    return out[::-1]


def disguise(text: str, kind: str) -> str:
    """The same entity in a form that the base patterns miss."""
    if kind == "email":
        name, _, host = text.partition("@")
        return f"{name}(at){host}"
    return text.lstrip("+") if kind == "phone" else text


class Window:
    """A window's candidates as rows of feature numbers, and which of them are gold."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], gold: list[tuple[int, int, int]], number: dict[str, int]):
        found = segments(text, tokens)
        self.n = len(tokens)
        self.i, self.j, self.k = (np.array([x[c] for x in found], np.int64) for c in (0, 1, 4))
        names = [[number.setdefault(f, len(number)) for f in x[5]] for x in found]
        self.row = np.repeat(np.arange(len(found)), [len(x) for x in names])
        self.feature = np.array([f for x in names for f in x], np.int64)
        place = {(a, b, k): at for at, (_, _, a, b, k, _) in enumerate(found)}
        self.gold = [place.get(g, -1) for g in gold]
        self.after = np.array([[number.setdefault(f, len(number)) for f in row] for row in AFTER])

    def likelihood(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of the gold entities and its gradient: forward and backward sums over segments."""
        m, low = len(self.i), -np.inf
        score = np.bincount(self.row, w[self.feature], m) if m else np.zeros(0)
        step = w[self.after]
        ahead, behind = np.full((self.n + 1, _NONE + 1), low), np.full((self.n + 1, _NONE + 1), low)
        ahead[0, _NONE], behind[self.n] = 0.0, 0.0
        total = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        at = 0
        into = np.full((self.n + 1, len(KINDS)), low)  # all ways to come to a segment of a kind that starts here
        for j in range(self.n + 1):
            if j:
                ahead[j] = ahead[j - 1]
                while at < m and self.j[at] == j:
                    k = self.k[at]
                    ahead[j, k] = np.logaddexp(ahead[j, k], into[self.i[at], k] + score[at])
                    at += 1
            into[j] = total(ahead[j][:, None] + step, 0)
        by_start = np.argsort(-self.i, kind="stable")
        at = 0
        for i in range(self.n - 1, -1, -1):
            behind[i] = behind[i + 1]
            while at < m and self.i[by_start[at]] == i:
                x = by_start[at]
                behind[i] = np.logaddexp(behind[i], step[:, self.k[x]] + score[x] + behind[self.j[x], self.k[x]])
                at += 1
        z = float(total(ahead[self.n], 0))
        gradient = np.zeros_like(w)
        value = -z
        if m:
            onward = score + behind[self.j, self.k] - z
            share = np.exp(into[self.i, self.k] + onward)
            np.subtract.at(gradient, self.feature, share[self.row])
            pairs = np.exp(ahead[self.i] + step[:, self.k].T + onward[:, None])  # for each candidate by the kind before
            np.subtract.at(gradient, self.after[:, self.k].T, pairs)
        last = _NONE
        for g in self.gold:
            np.add.at(gradient, self.feature[self.row == g], 1.0)
            gradient[self.after[last, self.k[g]]] += 1.0
            value += score[g] + step[last, self.k[g]]
            last = self.k[g]
        return value, gradient


def train(cases: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 4, rate: float = 0.3, l2: float = 1e-3) -> dict[str, float]:
    """Weights by gradient ascent on the conditional likelihood of (text, gold entities), from zero."""
    number: dict[str, int] = {}
    held = []
    for text, gold in cases:
        for tokens in windows(text):
            w = Window(text, tokens, [g for g in gold if tokens[0][0] <= g[0] and g[1] <= tokens[-1][1]], number)
            if -1 not in w.gold:  # else an entity isn't made of whole tokens
                held.append(w)
    if sum(len(w.gold) for w in held) < FEW:
        return dict(PRIOR)
    weights, seen = np.zeros(len(number)), np.full(len(number), 1e-2)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for at in order.permutation(len(held)):
            gradient = held[at].likelihood(weights)[1] - l2 * weights
            seen += gradient * gradient
            weights += rate * gradient / np.sqrt(seen)
    return dict(zip(number, weights.tolist(), strict=True))


def find(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and the model's that touch none of them, by start, then kind."""
    base = base_spans(text)
    if not _MARK.search(text):
        return base, base
    held: list[list[int]] = []  # the base spans' union, as disjoint intervals in order
    for a, b, _ in base:
        if held and a < held[-1][1]:
            held[-1][1] = max(held[-1][1], b)
        else:
            held.append([a, b])
    ends = [b for _, b in held]

    def touches(a: int, b: int) -> bool:
        k = bisect_right(ends, a)  # the first interval that ends behind a
        return k < len(held) and held[k][0] < b

    more = [s for tokens in windows(text) for s in decode(text, tokens, weights) if not touches(s[0], s[1])]
    return base, sorted(base + more, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def fit(docs: DataFrame, rows: int = 400, per_row: int = 16, tokens_each: int = 64) -> dict[str, float]:
    """Weights from about `rows` documents with a digit or an at-sign, drawn by a hash of the id.

    The sample's bounds: of a document the `per_row` parts of least checksum, where windows of over
    `tokens_each` tokens are cut into parts of that many.
    """
    marked = docs.select("doc_id", "text").where(F.col("text").rlike(r"[0-9]{3}|@"))
    n = marked.count()
    drawn = marked.where(C.hash_fraction("doc_id", 8, "text") < min(1.0, rows / max(1, n)))

    def make(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": [], "part": []}
        for i, text in zip(batch.column(0).to_pylist(), C.texts_of(batch, "text"), strict=True):
            runs = [t[k : k + tokens_each] for t in windows(text) for k in range(0, len(t), tokens_each)]
            parts = sorted({text[t[0][0] : t[-1][1]] for t in runs}, key=lambda p: (crc32(p.encode("utf-8", "replace")), p))[:per_row]
            out["doc_id"] += [i] * len(parts)
            out["part"] += parts
        return out

    got = sorted({(r["doc_id"] or 0, r["part"]) for r in C.per_batch(drawn, make, "doc_id long, part string").collect()})
    cases = []
    for _, part in got:
        gold, upto = [], 0
        for g in base_spans(part):  # of overlapping ones the first
            if g[0] >= upto:
                gold.append(g)
                upto = g[1]
        cases.append((part, gold))
        if len(gold) == 1:
            a, b, k = gold[0]
            other = disguise(part[a:b], KINDS[k])
            if other != part[a:b]:
                cases.append((part[:a] + other + part[b:], [(a, a + len(other), k)]))
    return train(cases)


def scan(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id and the digest columns of every row."""

    def make(batch: pa.RecordBatch) -> dict:
        out: dict = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        for text in C.texts_of(batch, "text"):
            base, spans = find(text, weights)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return {"doc_id": batch.column(0)} | out

    return C.per_batch(docs.select("doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, weights: dict[str, float]) -> str:
    """The text with each maximal run of overlapping spans replaced by its first kind in brackets."""
    merged: list[list[int]] = []
    for a, b, k in find(text, weights)[1]:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    cuts = [0, *(x for a, b, _ in merged for x in (a, b)), len(text)]
    kept = [text[a:b] for a, b in pairwise(cuts)][::2]
    return "".join(p + (f"[{KINDS[merged[i][2]].upper()}]" if i < len(merged) else "") for i, p in enumerate(kept))


def redact(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The same rows and columns with spans of `text` replaced and `n_chars`, where there is one, that of the new text; null texts stay null."""
    C.ship(docs.sparkSession)

    def run(batches):
        for batch in C.pieces(batches):
            at = batch.schema.get_field_index("text")
            new = [None if t is None else redacted(t, weights) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                columns[k] = pa.array([n if t is None else len(t) for n, t in zip(columns[k].to_pylist(), new, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op8_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return scan(docs, fit(docs))
