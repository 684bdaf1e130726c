"""Packing by power-of-two decomposition.

A document's token ids (with a closing id) are cut into pieces of binary length:
as many pieces of the longest length as fit, then one piece for each set bit of
the rest. Every piece is a sequence of its own in the bucket of its length, so no
sequence crosses documents and none needs padding.

The work is one pass over the texts without a shuffle. Text is tokenised by the
blank-separated chunk: the tokenizer drops white space and never joins across
it, so a chunk's ids do not depend on its neighbours and are looked up in a
bounded cache before the tokenizer is asked.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import small_batches

#: Longest piece, and the id that closes each document.
MAX_LENGTH = 4096
END_ID = 2
#: Marks that the tokenizer takes as tokens of its own before anything else.
OWN_MARKS = (b"<|startoftext|>", b"<|endoftext|>")
#: Chunks whose ids a worker remembers; it starts afresh beyond them.
CACHE_CHUNKS = 600_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


class Pieces(textops.Words):
    """Blank-separated runs, cut again where a letter meets an ASCII mark or digit.

    The tokenizer always ends a token there, unless an apostrophe takes part.
    Letters are a-z, put in lower case, and those of two bytes led by C3; what
    stands next to any other byte past 7F is left whole, and so is a text with
    one of the tokenizer's own marks.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        data = raw.tobytes()
        marked = any(m in data for m in OWN_MARKS)
        super().__init__(raw if marked else textops.lower(raw), at, textops.SPACED)
        if marked or not len(raw):
            return
        kind = _KIND[self.raw]
        led = np.flatnonzero(raw[:-1] == 0xC3) + 1
        kind[led] = np.where((raw[led] == 0x97) | (raw[led] == 0xB7), 3, 1)
        kind[led - 1] = kind[led]
        meet = np.flatnonzero((kind[1:] + kind[:-1] == 3) & (kind[1:] * kind[:-1] == 2)) + 1
        for bounds in ("start", "end"):
            flag = np.zeros(len(raw) + 1, bool)
            flag[getattr(self, bounds)] = True
            flag[meet] = True
            setattr(self, bounds, np.flatnonzero(flag))
        self.first = np.searchsorted(self.start, at)


#: 0 blank, 1 letter, 2 other ASCII, 3 apostrophe and unknown bytes.
_KIND = np.full(256, 2, np.int8)
_KIND[~textops.SPACED] = 0
_KIND[0x61:0x7B] = 1
_KIND[0x27] = 3
_KIND[0x80:] = 3
_KIND[[0x1C, 0x1D, 0x1E, 0x1F]] = 3


class ChunkEncoder:
    """Token ids of whole columns of text."""

    def __init__(self, tokenizer_path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.limit = cache_chunks
        self._reset()

    def _reset(self) -> None:
        self.values, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by value
        self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, values: np.ndarray, chunks: list[str]) -> None:
        lengths, parts = [], [self.pool]
        for i in range(0, len(chunks), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks[i : i + 4096], add_special_tokens=False)]
            lengths.extend(map(len, found))
            parts.append(np.fromiter(chain.from_iterable(found), np.uint32))
        length = np.array(lengths, np.int32)
        every = np.concatenate([self.values, values])
        slots = np.concatenate([self.slots, np.arange(len(self.start), len(self.start) + len(values), dtype=np.int32)])
        order = np.argsort(every)
        self.values, self.slots = every[order], slots[order]
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length, dtype=np.int32) - length])
        self.length = np.concatenate([self.length, length])
        self.pool = np.concatenate(parts)

    def _slots(self, values: np.ndarray) -> np.ndarray:
        """Where the ids of each value are, -1 where they aren't known."""
        if not len(self.values):
            return np.full(len(values), -1, np.int64)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return np.where(self.values[at] == values, self.slots[at], -1).astype(np.int64)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        words = Pieces(raw, at)
        raw = words.raw
        codes, distinct = pd.factorize(words.values())
        if len(self.values) + len(distinct) > self.limit:
            self._reset()
        slots = self._slots(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            one = np.zeros(len(distinct), np.int64)
            one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            slots[new] = np.arange(len(self.start), len(self.start) + len(new))
            self._learn(distinct[new], textops.texts(raw, words.start[one[new]], words.end[one[new]]))
        slots = slots[codes]
        length = self.length[slots].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.start[slots] - before[:-1], length) + np.arange(before[-1])]
        return ids, np.diff(before[words.first])


@lru_cache(1)
def encoder(tokenizer_path: str) -> ChunkEncoder:
    """A worker's own, kept from task to task."""
    return ChunkEncoder(tokenizer_path)


textops.LEFT.append(encoder.cache_clear)


def pieces(n: int, longest: int) -> list[int]:
    """Lengths, longest first; they sum to n and are powers of two."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def power_of_two_pieces(docs: DataFrame, tokenizer_path: str, *, max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text).

    Null and empty texts are the closing id alone: one piece of one token.
    Repeated rows are packed each for itself; other columns are ignored.
    ``with_ids`` adds the token ids of each piece.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool = encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        for batch in textops.slices(batches, keep=True):
            raw, at = textops.utf8(batch.column(1))
            flat, count = tool.encode(raw, at)
            first = np.concatenate([[0], np.cumsum(count)])
            cut = [pieces(int(n) + 1, max_length) for n in count]
            rows = np.fromiter(map(len, cut), np.int64, len(cut))
            length = np.fromiter((x for p in cut for x in p), np.int64, int(rows.sum()))
            row = np.repeat(np.arange(len(cut)), rows)
            before = np.cumsum(length) - length
            start = before - before[np.cumsum(rows) - rows][row]
            # the closing ids are put in after every text's own
            whole = np.insert(flat, first[1:], np.uint32(end_id)) if len(cut) else flat
            data = whole.astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(before.tolist(), length.tolist(), strict=True)]
            columns = [
                batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(count[row] + 1),
                pa.array(sequence + np.arange(len(row))), pa.array(np.zeros(len(row), np.int64)), pa.array(np.log2(length).astype(np.int32)),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(before, len(whole)).astype(np.int32)), pa.array(whole.astype(np.int32))))
                names.append("ids")
            sequence += len(row)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
