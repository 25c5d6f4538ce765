"""Token ids by the tokenizers library, with a bounded memo of words.

Byte-level pre-tokenisation never crosses a single space between two characters
that aren't white space, nor a single line end between such characters, nor the
place between a letter or digit and a run of ASCII punctuation that ends its word.
A batch of texts is cut there into words (a line end stays with the word after it),
each distinct word of the batch is looked up or encoded once, and the ids are put
together by their places.  Texts with other runs of white space at those places, or
with a special token's string, are encoded whole.  The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and code points in a generation of the memo, a bound on a Python worker's memory.
#: A full generation becomes the old one; the words of it that occur again move to the new one.
MEMO, MEMO_CHARS = 400_000, 6_000_000
#: Bytes of text whose words are looked up together.
TOGETHER = 4 << 20
#: White space by any of the libraries' tables, besides the space and the line end.
_ODD = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{180e}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_PUNCT = string.punctuation
_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file, kept across tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        if len(vocab) > 1 << 16:
            raise ValueError("the memo holds ids of 16 bits")
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.line = np.zeros_like(self.starts)
        self.line[vocab["Ċ"]] = True
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        quoted = "".join("|" + "".join(rf"\x{{{ord(c):x}}}" for c in s) for s in special)
        # other white space, or more than one character of it, may join a run with what is cut away
        self.unsound = rf"{_ODD}|  |\n\n| \n|\n |\A[ \n]|[ \n]\z{quoted}"
        self.memo: dict[str, bytes] = {}  # a word after a space, or with the line end before it
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16).tobytes()

    def _learn(self, words: list[str], before: str, marks: np.ndarray) -> None:
        """Encode new words, without white space inside, as they are after `before`; marks: the ids that begin a word there."""
        join = before if before == " " else ""
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            text = before * (before == " ") + join.join(part)
            self.held += len(text)
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            cut = np.flatnonzero(marks[ids])
            if len(cut) != len(part):
                self.memo.update((w, self._whole(before + w if before == " " else w)) for w in part)
                continue
            raw, ends = ids.tobytes(), [*(cut * 2).tolist(), len(ids) * 2]
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, ends, ends[1:])), strict=True))

    def _renew(self, new: list[str]) -> None:
        """Put words into the memo: from the old generation, from a stem and its punctuation, or encoded."""
        memo, old, held = self.memo, self.old, 0
        heads, composed, fresh, stems = [], [], [], set()
        for w, x in zip(new, map(old.get, new), strict=True):
            if x is not None:
                memo[w] = x
                held += len(w)
            elif w[-1:] in _PUNCT and w[:1] != "\n" and (stem := w.rstrip(_PUNCT)) and stem[-1] < "ɐ" and stem[-1].isalnum():
                composed.append((w, stem))
                if stem not in memo:
                    stems.add(stem)
            elif w[:1] == "\n":
                heads.append(w)
            else:
                fresh.append(w)
        for w in stems.intersection(old):
            memo[w] = old[w]
        stems.difference_update(old, fresh)
        self._learn([*fresh, *stems], " ", self.starts)
        self._learn(heads, "\n", self.line)
        tails = self.tails
        for w, stem in composed:
            tail = w[len(stem) :]
            if (x := tails.get(tail)) is None:
                x = self._whole(tail)
                if len(tails) < 10_000 and len(tail) < 20:
                    tails[tail] = x
            memo[w] = memo[stem] + x
            held += len(w)
        self.held += held

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose cuts are sound, one after another, and where each text's begin; a line end's id stands before each text's."""
        if len(self.memo) > MEMO or self.held > MEMO_CHARS:
            self.old, self.memo, self.held = self.memo, {}, 0
        memo = self.memo
        marked = pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n")
        lists = pc.split_pattern(pc.utf8_slice_codeunits(marked, 1), " ")  # each text begins with its line end
        coded = lists.values.dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = list(map(memo.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            self._renew([words[i] for i in gaps])
            for i in gaps:
                ids[i] = memo[words[i]]
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat, begin = np.frombuffer(b"".join(ids), np.uint16), np.cumsum(each) - each
        n = each[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat((begin[which] - ends[:-1]).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)]
        return out, ends[lists.offsets.to_numpy()]

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids (16-bit unsigned) of whole texts, null as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, self.unsound), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            if text := texts[i].as_py():
                out[i] = np.frombuffer(self._whole(text), np.uint16)
        sound = np.flatnonzero(~odd)
        if not len(sound):
            return out
        group = np.cumsum(pc.binary_length(texts).to_numpy()[sound].astype(np.int64)) // TOGETHER
        for part in np.split(sound, np.flatnonzero(np.diff(group)) + 1):
            ids, at = self._together(texts.take(pa.array(part)))
            for i, a, b in zip(part.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[i] = ids[a + 1 : b]
        return out
