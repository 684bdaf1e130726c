"""Document fingerprints by Order MinHash.

The k-mers of a text are runs of words, each numbered by its occurrence in the
text. A numbered k-mer's hash names one of the signature's entries and its rank
there; an entry takes its smallest k-mers, puts them back in text order and
hashes the tuple. Two texts agree on an entry only if they share those k-mers in
the same order, so the share of equal entries follows edit distance rather than
set likeness. Entries without k-mers borrow from the next one that has some.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import small_batches
from .textops import U64

#: Words of a k-mer, k-mers of a tuple, entries of a signature (a power of two).
GRAM = 3
TUPLE = 2
ENTRIES = 64
#: A longer run of non-blanks is cut into tokens of so many bytes.
TOKEN_BYTES = 16

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Tokens(textops.Words):
    """Blank-separated words; long ones cut into pieces counted from their start."""

    def __init__(self, raw, at, size):
        super().__init__(raw, at, textops.SPACED)
        parts = -(-(self.end - self.start) // size)
        if len(parts) and parts.max() > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.repeat(self.start, parts) + nth * size
            self.end = np.minimum(start + size, np.repeat(self.end, parts))
            self.start, self.first = start, np.searchsorted(start, self.at)


def signatures(raw: np.ndarray, at: np.ndarray, gram: int = GRAM, tuple_size: int = TUPLE, entries: int = ENTRIES) -> np.ndarray:
    """A row of 16-bit entries for each text."""
    texts = len(at) - 1
    tokens = _Tokens(raw, at, TOKEN_BYTES)
    values, count = tokens.values(), tokens.count
    kmers, index = textops.grams(values, tokens.first, gram)
    owner = np.searchsorted(tokens.first, index, "right") - 1
    few = np.flatnonzero(count < gram)
    if len(few):  # the whole text is the one k-mer
        whole = textops.span_values(raw, at[few], at[few + 1], seed=1)
        kmers, owner, index = np.concatenate([kmers, whole]), np.concatenate([owner, few]), np.concatenate([index, tokens.first[few]])
    bits = max(1, int(texts).bit_length())
    keep = U64(bits)
    label = owner.astype(U64) << U64(64 - bits)
    # number the occurrences of each k-mer of a text, in text order
    key = label | (kmers >> keep)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    many = np.diff(np.append(starts, len(key))) > 1
    again = np.flatnonzero(many[run])
    if len(again):
        order[again] = order[again][np.lexsort((index[order[again]], run[again]))]
    nth = np.arange(len(key)) - starts[run]
    hashes = textops.mix(kmers[order] + nth.astype(U64) * U64(0x9E3779B97F4A7C15))
    # the smallest of each entry: the entry is in the hash's highest bits
    key = (label[order] | (hashes >> keep)) if len(order) else key
    place, best = index[order], np.argsort(key)
    key, place, hashes = key[best], place[best], hashes[best]
    shift = U64(64 - bits - (entries.bit_length() - 1))
    cell = (key >> shift).astype(np.int64)
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(cell)))
    got_place = np.full((len(starts), tuple_size), np.iinfo(np.int64).max)
    got_hash = np.zeros((len(starts), tuple_size), U64)
    for j in range(tuple_size):
        has = size > j
        got_place[has, j] = place[starts[has] + j]
        got_hash[has, j] = hashes[starts[has] + j]
    rank = np.argsort(got_place, axis=1, kind="stable")
    got_hash = np.take_along_axis(got_hash, rank, 1)
    value = np.zeros(len(starts), U64)
    for j in range(tuple_size):
        value = textops.mix(value + got_hash[:, j])
    out = np.zeros((texts, entries), np.uint16)
    full = np.zeros((texts, entries), bool)
    out.reshape(-1)[cell[starts]] = (value >> U64(48)).astype(np.uint16)
    full.reshape(-1)[cell[starts]] = True
    # borrow from the next entry that has k-mers, around the end
    ahead = np.where(np.concatenate([full, full], 1), np.arange(2 * entries), 4 * entries)
    ahead = np.minimum.accumulate(ahead[:, ::-1], 1)[:, ::-1][:, :entries] % entries
    return np.take_along_axis(out, ahead, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def hexed(rows: np.ndarray) -> pa.Array:
    wide = rows.astype(">u2").tobytes().hex()
    size = rows.shape[1] * 4
    return pa.array([wide[i * size : (i + 1) * size] for i in range(len(rows))], pa.string())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its signature as hex, for each row of ``docs``; null is empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), hexed(signatures(*textops.utf8(batch.column(1))))], names=["doc_id", "fingerprint"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _bucket(bounds: list[int]) -> Column:
    """Which range of ids a row is in: a binary search of a literal array, whose plan doesn't grow with it."""
    if not bounds:
        return F.lit(0)
    middle = "cast((a.low + a.high) div 2 as int)"
    step = f"""if(a.low >= a.high, a, if(doc_id <= array({', '.join(f'{b}L' for b in bounds)})[{middle}],
        named_struct('low', a.low, 'high', {middle}), named_struct('low', {middle} + 1, 'high', a.high)))"""
    return F.expr(f"aggregate(sequence(1, {len(bounds).bit_length()}), named_struct('low', 0, 'high', {len(bounds)}), (a, i) -> {step}, a -> a.low)")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last row seen: id, tail, text, signature
    for batch in textops.slices(batches, limit=textops.CHUNK_BYTES // 2):
        column = batch.column(batch.schema.get_field_index("text"))
        raw, at = textops.utf8(column)
        own = signatures(raw, at)
        text = [t or "" for t in column.to_pylist()]
        ids, tail = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if held:
            ids, tail, text, own = [held[0], *ids], [held[1], *tail], [held[2], *text], np.concatenate([held[3][None], own])
        held = ids[-1], tail[-1], text[-1], own[-1]
        rows = [i for i in range(len(ids) - 1) if not tail[i]]
        if not rows:
            continue
        edited = [text[i][: len(text[i]) - len(text[i]) // 2] + text[i + 1][: len(text[i]) // 2] for i in rows]
        marks = signatures(*textops.utf8(pa.array(edited, pa.large_string())))
        here = np.array(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(text[i]) for i in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), hexed(own[here]), hexed(marks),
                pa.array(likeness(own[here], marks)), pa.array(likeness(own[here], own[here + 1])),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how near they and the next text's are.

    The edited text has the last half of its code points (rounded down) replaced
    by the first as many, or all, of the next text by descending doc_id; the last
    takes the first's. Null ids come last, rows of one id by text. Null texts are
    empty; an empty table gives no rows; other columns are ignored.

    Texts move once, dealt out by ranges of doc_id with the first row of each
    range copied to the range before it, so every task streams through its rows.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    bounds = sorted(set(cuts)) if parts > 1 else []
    dealt = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket(bounds)))
    tops = sorted(dealt.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect(), reverse=True)  # one row a range
    before = [(row.top, tops[i - 1].bucket) for i, row in enumerate(tops)]
    first = spark.createDataFrame(before, "top long, before int")
    rows = (
        dealt.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("top")), "left")
        .select("doc_id", "text", F.explode(F.expr("filter(array(struct(bucket, 0 as tail), struct(before as bucket, 1 as tail)), x -> x.bucket is not null)")).alias("at"))
        .select("doc_id", F.col("at.tail").alias("tail"), F.col("at.bucket").alias("bucket"), "text")
    )
    return rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text")).mapInArrow(_scan, SCHEMA)
