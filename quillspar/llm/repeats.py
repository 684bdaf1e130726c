"""Removal of repeated byte strings across and inside documents.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too.

The texts are parsed at content-defined anchors first: of all k-grams of a window
of LENGTH bytes the one of the smallest hash is its anchor, so equal windows have
equal anchors at equal places, and the windows of one anchor are a run. A run
whose anchor occurs nowhere else can't repeat, and one whose whole string occurs
again repeats whole. What is left, the strings at the edges of what repeats, is
brought together by anchor and decided by Burrows-Wheeler transforms: each shard
of strings gets its own, they are merged by interleave refinement, and starts
whose common prefix with a neighbour reaches LENGTH repeat. The symbols are words
of eight bytes in all eight phases, so LENGTH bytes take LENGTH / 8 passes.

An anchor with more strings than one task should hold (``GROUP_RUNS``) is split
by content instead: its windows are named by their hash and dealt out by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, textops
from .shared import settle, small_batches
from .textops import U64

LENGTH = 200
GRAM = 80
#: A longer text is parsed in parts that overlap.
PART_BYTES = 8 << 20
#: Runs of an anchor that one task brings together; bytes of a shard, and of shards merged at once.
GROUP_RUNS = 4096
#: Bytes of text that are parsed or cut at once; some twenty words are held for each.
SLICE_BYTES = 1 << 20
SHARD_BYTES = 128 << 10
MERGE_BYTES = 512 << 10
WORD = 8
_PLACE = 24  # bits of a place in a part
BROADCAST_CELLS = 1_000_000


class Parse:
    """Runs of window starts that share an anchor, over a column of texts."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        self.at, self.length = at, length
        up, self.down = textops.powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * up[:-1], out=self.total[1:])
        starts = len(raw) - length + 1
        self.text = self.low = self.high = self.anchor = np.zeros(0, np.int64)
        if starts <= 0:
            return
        grams = self.values(np.arange(len(raw) - gram + 1), gram)
        key = (grams >> U64(_PLACE) << U64(_PLACE)) | (U64((1 << _PLACE) - 1) - np.arange(len(grams), dtype=U64))
        # smallest of each window's k-grams, the rightmost of equal ones
        width, span = length - gram + 1, 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        place = ((1 << _PLACE) - 1) - (key & U64((1 << _PLACE) - 1)).astype(np.int64)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:starts]
        whole = np.arange(starts) + length <= at[text + 1]
        new = np.ones(starts, bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
        self.low = np.flatnonzero(new & whole)
        last = np.ones(starts, bool)
        last[:-1] = new[1:] | ~whole[1:]
        self.high = np.flatnonzero(last & whole)
        self.text = text[self.low]
        self.anchor = grams[place[self.low]]
        size = self.high - self.low + length
        self.string = textops.mix(self.values(self.low, size) + textops.mix(((place[self.low] - self.low) << 32 | size).astype(U64)))

    def values(self, start: np.ndarray, size) -> np.ndarray:
        return textops.mix((self.total[start + size] - self.total[start]) * self.down[start])


def _parts(batches: Iterator[pa.RecordBatch], column: str, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their bytes; a very long text comes alone and in parts, with where the part begins."""
    for batch in textops.slices(batches, column, SLICE_BYTES):
        raw, at = textops.utf8(batch.column(batch.schema.get_field_index(column)))
        for begin in range(0, max(1, len(raw) - length + 1), PART_BYTES) if batch.num_rows == 1 else (0,):
            part = raw[begin : begin + PART_BYTES + length - 1] if batch.num_rows == 1 else raw
            yield batch, part, np.array([0, len(part)]) if batch.num_rows == 1 else at, np.full(batch.num_rows, begin)


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at, begin in _parts(batches, "text", length):
            parse = Parse(raw, at, length, gram)
            if not len(parse.low):
                continue
            base = at[parse.text] - begin[parse.text]
            # one of the equal strings of a slice stands for all of them, which repeat: they are dealt out by place
            codes = pd.factorize(parse.string)[0]
            several = np.bincount(codes)[codes] > 1
            later = np.ones(len(codes), bool)
            later[np.unique(codes, return_index=True)[1]] = False
            deal = np.where(later, textops.mix(parse.anchor + textops.mix(np.arange(len(codes), dtype=U64))), parse.anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal.view(np.int64)), pa.array(later), pa.array(parse.anchor.view(np.int64)), pa.array(parse.string.view(np.int64)), batch.column(0).take(pa.array(parse.text)), pa.array(parse.low - base), pa.array(parse.high - base), pa.array(several)],
                names=["deal", "later", "anchor", "string", "row", "low", "high", "several"],
            )

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch with the last row of the one before and the first of the one after."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            yield from _three(held[0], held[1], batch.slice(0, 1))
            held = held[1].slice(held[1].num_rows - 1), batch
        else:
            held = None, batch
    if held is not None:
        yield from _three(held[0], held[1], None)


def _three(before, batch, after):
    parts = [x for x in (before, batch, after) if x is not None]
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    yield whole, int(before is not None), batch.num_rows


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by anchor and string, after those that another of their slice stands for: those that repeat whole, and those whose windows are to be compared."""
    for whole, skip, rows in _neighbours(batches):
        first, anchor, string, several = (whole.column(n).to_numpy(zero_copy_only=False) for n in ("later", "anchor", "string", "several"))
        near = (anchor[1:] == anchor[:-1]) & ~first[1:] & ~first[:-1]
        same = near & (string[1:] == string[:-1])
        pad = lambda x: (np.concatenate([[False], x]), np.concatenate([x, [False]]))
        (near_before, near_after), (same_before, same_after) = pad(near), pad(same)
        repeats = same_before | same_after | several
        compared = (near_before & ~same_before) | (near_after & ~same_after)
        keep = np.flatnonzero((repeats | compared)[skip : skip + rows]) + skip
        taken = whole.take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*(taken.column(n) for n in ("anchor", "row", "low", "high")), pa.array(repeats[keep]), pa.array(compared[keep])], names=["anchor", "row", "low", "high", "repeats", "compared"])


def _strings(length: int):
    """The string under each run, with its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, limit=SLICE_BYTES):
            raw, at = textops.utf8(batch.column(batch.schema.get_field_index("text")))
            runs = batch.column(batch.schema.get_field_index("runs"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            anchor, low, high = (flat.field(i).to_numpy() for i in range(3))
            begin, end = low + at[owner], high + at[owner] + length
            data = raw.tobytes()
            for a in range(0, len(low), 4096):
                cut = slice(a, a + 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[cut]), batch.column(0).take(pa.array(owner[cut])), pa.array(low[cut]), pa.array([data[x:y] for x, y in zip(begin[cut].tolist(), end[cut].tolist(), strict=True)], pa.binary())],
                    names=["anchor", "row", "low", "string"],
                )

    return run


def _decided(length: int):
    """Of strings sorted by anchor, the starts that repeat: merged transforms of some anchors at a time."""

    def decide(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = [r[2] for r in rows]
        first = np.cumsum([0, *map(len, data)])
        width = WORD if length % WORD == 0 else 1
        values, byte = bwt.in_words(np.frombuffer(b"".join(data), np.uint8), first, width)
        symbols = pd.factorize(values)[0].astype(np.int64) + 1
        symbols[byte < 0] = 0
        ends = np.flatnonzero(byte < 0) + 1
        cuts = ends[np.searchsorted(ends, np.arange(SHARD_BYTES, len(symbols), SHARD_BYTES))]
        bounds = np.unique(np.concatenate([[0], cuts, [len(symbols)]]))
        shards = [symbols[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        at = np.sort(np.concatenate([byte[b + found] for b, found in zip(bounds[:-1], bwt.repeated(shards, length // width), strict=True)]))
        owner = np.searchsorted(first, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        last = np.append(new[1:], True) if len(at) else new
        row, low = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        shift = low[owner] - first[owner]
        return pa.RecordBatch.from_arrays([pa.array(row[owner[new]]), pa.array((at + shift)[new]), pa.array((at + shift)[last])], names=["row", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group, size, last = [], [], 0, None

        def close():
            nonlocal group
            if len(group) > 1:  # an anchor alone repeats nothing
                rows.extend(group)
            group = []

        for batch in batches:
            for anchor, row, low, string in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if anchor != last:
                    close()
                    last = anchor
                    if size >= MERGE_BYTES:
                        if rows:
                            yield decide(rows)
                        rows, size = [], 0
                group.append((row, low, string))
                size += len(string)
        close()
        if rows:
            yield decide(rows)

    return run


def _windows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, limit=SLICE_BYTES):
            raw, at = textops.utf8(batch.column(batch.schema.get_field_index("text")))
            parse = Parse.__new__(Parse)
            up, parse.down = textops.powers(len(raw) + 1)
            parse.total = np.zeros(len(raw) + 1, U64)
            np.cumsum((raw.astype(U64) + U64(1)) * up[:-1], out=parse.total[1:])
            runs = batch.column(batch.schema.get_field_index("runs"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            low, high = flat.field(1).to_numpy(), flat.field(2).to_numpy()
            size = high - low + 1
            for a in range(0, len(low), 4096):
                n = size[a : a + 4096]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(low[a : a + 4096], n) + nth
                text = np.repeat(owner[a : a + 4096], n)
                names = parse.values(place + at[text], length)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(place)], names=["name", "row", "low"])

    return run


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by name, those whose name another has."""
    for whole, skip, rows in _neighbours(batches):
        name = whole.column(0).to_numpy()
        same = name[1:] == name[:-1]
        more = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        taken = whole.take(pa.array(np.flatnonzero(more[skip : skip + rows]) + skip))
        yield pa.RecordBatch.from_arrays(taken.columns[1:3], names=["row", "low"])


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, limit=SLICE_BYTES):
            raw, at = textops.utf8(batch.column(batch.schema.get_field_index("text")))
            runs = batch.column(batch.schema.get_field_index("runs"))
            count = np.diff(runs.offsets.to_numpy())
            flat = runs.flatten()
            owner = np.repeat(np.arange(batch.num_rows), count)
            cover = np.zeros(len(raw) + 1, np.int32)
            np.add.at(cover, flat.field(0).to_numpy() + at[owner], 1)
            np.add.at(cover, flat.field(1).to_numpy() + at[owner] + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.zeros(len(raw), bool)
            if len(raw):
                edge[1:] = gone[1:] & ~gone[:-1]
                first = at[:-1][at[:-1] < len(raw)]
                edge[first] = gone[first]
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, edge)]
            removed, spans = ((x[at[1:]] - x[at[:-1]]) for x in sums)
            left, to = raw[~gone].tobytes(), at - sums[0][at]
            texts = [left[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.diff(at)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def without_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, group_runs: int = GROUP_RUNS, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (doc_id, text).

    A null text is empty; a text shorter than ``length`` loses nothing. Repeated
    rows lose all that is long enough. Rows of one doc_id, or of none, are told
    apart by a written row number. Other columns are ignored. ``with_text`` adds
    the remaining bytes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    unique = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    rows = docs.select(F.col("doc_id").alias("row"), "doc_id", "text") if unique else settle(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "repeats-rows")
    runs = rows.select("row", "text").mapInArrow(_runs(length, gram), "deal long, later boolean, anchor long, string long, row long, low long, high long, several boolean")
    marks = settle(runs.repartition(parts, "deal").sortWithinPartitions(F.desc("later"), "anchor", "string").mapInArrow(_settled, "anchor long, row long, low long, high long, repeats boolean, compared boolean"), "repeats-marks")
    compared = marks.where("compared")
    sizes = compared.groupBy("anchor").agg(F.count("*").alias("runs")).where(F.col("runs") > group_runs).select("anchor", F.lit(True).alias("hot"))
    compared = settle(compared.join(sizes, "anchor", "left").select("anchor", "row", "low", "high", F.coalesce("hot", F.lit(False)).alias("hot")), "repeats-compared")

    def beside(which: DataFrame) -> DataFrame:
        side = which.groupBy("row").agg(F.collect_list(F.struct("anchor", "low", "high")).alias("runs"))
        return rows.select("row", "text").join(F.broadcast(side) if which.count() <= BROADCAST_CELLS else side, "row").select("row", "text", "runs")

    strings = beside(compared.where("not hot")).mapInArrow(_strings(length), "anchor long, row long, low long, string binary")
    decided = strings.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_decided(length), "row long, low long, high long")
    every = marks.where("repeats").select("row", "low", "high").unionByName(decided)
    if not compared.where("hot").isEmpty():
        windows = beside(compared.where("hot")).mapInArrow(_windows(length, gram), "name long, row long, low long")
        again = windows.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(_again, "row long, low long")
        every = every.unionByName(again.select("row", "low", F.col("low").alias("high")))
    gone = every.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    none = F.expr("cast(array() as array<struct<low:bigint,high:bigint>>)")
    found = rows.join(gone, "row", "left").select("row", "doc_id", "text", F.coalesce("runs", none).alias("runs"))
    found = found.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found if with_text else found.drop("kept")
