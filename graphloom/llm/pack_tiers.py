"""Packing: hierarchical, for several context sizes.

A document's ids are cut into full windows of the longest context; what is left
goes to the smallest tier that holds it.  Each tier from the longest down packs
its pieces one a window and fills the gap with the longest pieces of shorter
tiers that fit; the last gap takes the head of a piece, whose tail goes back to
its tier.  Full windows are emitted; what is left at the end of a block of
documents goes into one shared remainder window, which alone is padded.  Step groups
take the same number of tokens: sequences are dealt to the open group, and a
group closes at its budget.

Blocks are scan partitions, so packing needs no shuffle, and a task holds the
lengths of at most BLOCK documents; ids flow through for their checksums only.

Defined cases: a null text is empty and has the end id alone; a text of any length
is cut into full windows and a rest; repeated rows are packed each, pieces of equal
length in the order of their documents; an empty table gives an empty table.  Only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .token_parquet import END_ID, vocabulary
from .tokens import encoder

TIERS = (128, 256, 512, 1024)
#: Documents packed together, and sequences of the longest context in a step group.
BLOCK, STEP = 8192, 8

Piece = tuple[int, int, int]  # document, start, length


class Shelf:
    """Pieces by length; the longest that fits a gap, first in first out."""

    def __init__(self, longest: int):
        self.by = [deque() for _ in range(longest + 1)]
        self.present = 0  # bit n: there is a piece of length n

    def put(self, piece: Piece) -> None:
        self.by[piece[2]].append(piece)
        self.present |= 1 << piece[2]

    def take(self, most: int, least: int = 1) -> Piece | None:
        n = (self.present & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < least:
            return None
        piece = self.by[n].popleft()
        if not self.by[n]:
            self.present &= ~(1 << n)
        return piece


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[list[Piece]]:
    """Sequences of pieces (document, start, length) that cover each document once.

    All sequences but the last fill a tier's window exactly.
    """
    top = tiers[-1]
    shelf = Shelf(top)
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % top, top):
            yield [(doc, start, top)]
        if n % top:
            shelf.put((doc, n - n % top, n % top))
    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while (first := shelf.take(tier, below + 1)) is not None:
            window, gap = [first], tier - first[2]
            while gap and (piece := shelf.take(gap)) is not None:
                window.append(piece)
                gap -= piece[2]
            if gap and (piece := shelf.take(top)) is not None:  # longer than the gap: its head fills it
                doc, start, n = piece
                window.append((doc, start, gap))
                shelf.put((doc, start + gap, n - gap))
                gap = 0
            yield window


def step_groups(sizes: Iterable[int], budget: int) -> Iterator[int]:
    """A group number for each sequence: groups of `budget` tokens, next-fit over a few open groups."""
    free: list[list[int]] = []  # [room, number]
    made = 0
    for n in sizes:
        slot = next((g for g in free if g[0] >= n), None)
        if slot is None:
            slot = [budget, made]
            made += 1
            free.append(slot)
            if len(free) > 8:
                free.pop(0)
        slot[0] -= n
        yield slot[1]
        if not slot[0]:
            free.remove(slot)


def pack_documents(docs: DataFrame, vocab: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier and step_id."""
    C.ship(docs.sparkSession)

    def flush(base: int, block: list[tuple[int, np.ndarray]]):
        out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id")}
        seqs = list(pack([len(ids) for _, ids in block], tiers))
        sizes = [sum(p[2] for p in s) for s in seqs]
        for k, (seq, size, step) in enumerate(zip(seqs, sizes, step_groups(sizes, STEP * tiers[-1]), strict=True)):
            offset, tier = 0, next(t for t in tiers if t >= size)
            for doc, start, n in seq:
                i, ids = block[doc]
                for name, v in zip(out, (i, start, n, crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), base + k, offset, tier, base + step), strict=True):
                    out[name].append(v)
                offset += n
        kinds = (pa.int64(),) * 7 + (pa.int32(), pa.int64())
        return len(seqs), pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def run(batches):
        enc, base, block = encoder(vocab), TaskContext.get().partitionId() << 40, []
        held = 0
        for batch in C.pieces(batches, 2048):
            for i, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                block.append((i, np.append(ids, np.uint16(end_id))))
                held += len(ids) + 1
            if len(block) >= BLOCK or held > 16 << 20:
                n, got = flush(base, block)
                yield got
                base, block, held = base + n, [], 0
        if block:
            yield flush(base, block)[1]

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long")


def op6_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.documents(spark, sf_dir), vocabulary())
