"""Benchmark decontamination by winnowing.

Of every sliding window of k-gram hashes the smallest is kept, on both sides. A
shared span of ``window`` words holds ``window - k + 1`` k-grams and so, on both
sides, the same kept one at the same place: joining kept hashes and extending
each hit word by word finds every shared span of that length or more. An item
of fewer words is one window of its own length, winnowed under that length.

The benchmark is read in blocks of bounded size. One block is one pass over the
documents without a shuffle; the hits of several blocks meet by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import settle, small_batches

#: Words of a window, and of the k-grams that are kept.
WINDOW = 13
GRAM = 5
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Ids that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Hit pairs extended at once.
PAIRS = 1 << 20

SCHEMA = "row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def winnow(values: np.ndarray, first: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-gram hashes and the words where they start; ties go to the rightmost."""
    hashes, index = textops.grams(values, first, k)
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0], index[:0]
    best, place = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        less = hashes[j : n + j] <= best
        np.copyto(best, hashes[j : n + j], where=less)
        place[less] = j
    text = np.searchsorted(first, index, "right")
    whole = text[:n] == text[width - 1 :]
    kept = np.zeros(len(hashes), bool)
    kept[(np.arange(n) + place)[whole]] = True
    return hashes[kept], index[kept]


class BenchmarkIndex:
    """Kept hashes of a block of items, by window length."""

    def __init__(self, item_ids: list[str], item_texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        raw, at = textops.utf8(pa.array(item_texts, pa.string()))
        words = textops.Words(textops.lower(raw), at, textops.ALNUM)
        self.values, self.first, self.ids = words.values(), words.first, item_ids
        owner = words.owner
        self.begin, self.end = self.first[owner], self.first[owner + 1]
        self.owner = owner
        lengths = np.minimum(words.count, window)
        self.classes = []
        for length in sorted(set(lengths[lengths > 0].tolist())):
            k = min(gram, length)
            hashes, index = winnow(self.values, self.first, k, length - k + 1)
            own = lengths[owner[index]] == length
            order = np.argsort(hashes[own], kind="stable")
            self.classes.append((length, k, hashes[own][order], index[own][order]))

    def hits(self, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of document words (start, end) that lie in an occurring window, and the item of each."""
        found = [(np.zeros(0, np.int64),) * 3]
        for length, k, hashes, index in self.classes:
            kept, at = winnow(values, first, k, length - k + 1)
            low, high = np.searchsorted(hashes, kept, "left"), np.searchsorted(hashes, kept, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            low, many, at = low[hit], (high - low)[hit], at[hit]
            text = np.searchsorted(first, at, "right") - 1
            begin, end = first[text], first[text + 1]
            upto = np.cumsum(many)
            for a in range(0, int(upto[-1]), PAIRS):
                pair = np.arange(a, min(a + PAIRS, int(upto[-1])))
                i = np.searchsorted(upto, pair, "right")
                q = index[low[i] + pair - (upto[i] - many[i])]
                found.append(self._extend(values, at[i], q, begin[i], end[i], length, k))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _extend(self, values, p, q, begin, end, length, k):
        reach = length - k
        sides = []
        for step, from_p, from_q in ((-1, p - 1, q - 1), (1, p + k, q + k)):
            got, going = np.zeros(len(p), np.int64), np.ones(len(p), bool)
            for j in range(reach):
                x, y = from_p + step * j, from_q + step * j
                going &= (x >= begin) & (x < end) & (y >= self.begin[q]) & (y < self.end[q])
                going[going] = values[x[going]] == self.values[y[going]]
                got += going
            sides.append(got)
        # the k words themselves, for hashes that met by chance
        same = np.ones(len(p), bool)
        for j in range(k):
            same &= values[p + j] == self.values[q + j]
        whole = same & (sides[0] + sides[1] >= reach)
        return (p - sides[0])[whole], (p + k + sides[1])[whole], self.owner[q][whole]


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = index.value
        for batch in textops.slices(batches):
            raw, at = textops.utf8(batch.column(2))
            words = textops.Words(textops.lower(raw), at, textops.ALNUM)
            first, n = words.first, batch.num_rows
            start, end, item = bench.hits(words.values(), first)
            cover = np.zeros(int(first[-1]) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, end, -1)
            inside = np.cumsum(cover[:-1]) > 0
            edge = inside.astype(np.int8)
            before = np.concatenate([[0], edge[:-1]])
            before[first[:-1][first[:-1] < len(edge)]] = 0
            after = np.concatenate([edge[1:], [0]])
            after[first[1:] - 1] = 0
            a, b = np.flatnonzero((edge == 1) & (before == 0)), np.flatnonzero((edge == 1) & (after == 0)) + 1
            row = np.searchsorted(first, a, "right") - 1
            texts = np.searchsorted(first, start, "right") - 1
            pairs = np.unique(np.stack([texts, item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(words.count.astype(np.int64)),
                    _lists(np.bincount(row, minlength=n), pa.StructArray.from_arrays([pa.array(a - first[row]), pa.array(b - first[row])], names=["start", "end"])),
                    _lists(np.bincount(pairs[:, 0], minlength=n), pa.array([bench.ids[i] for i in pairs[:, 1]], pa.string())),
                ], names=["row", "doc_id", "n_words", "spans", "items"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words, items with occurring windows, for each row of ``docs`` (doc_id, text).

    Words are runs of ASCII digits, lower-cased ASCII letters and characters past
    U+007F. A null or wordless text has no words and no hits; null or wordless
    items and items without id never occur; items of equal text all count. An
    empty benchmark leaves all documents clean. Repeated rows are judged each for
    itself; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = small_batches(docs).select(F.lit(0).cast("long").alias("row") if blocks == 1 else F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = []
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        got = part.distinct().collect()  # bounded: one block
        index = spark.sparkContext.broadcast(BenchmarkIndex([r.item_id for r in got], [r.text for r in got], window, gram))
        found.append(rows.mapInArrow(_scan(index), SCHEMA))
    if blocks == 1:
        return found[0].drop("row")
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return (
        every.groupBy("row", "doc_id", "n_words")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        .select("doc_id", "n_words", merged_spans("spans").alias("spans"), "items")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns as they were."""
    rows = settle(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "decontam-rows")
    found = contamination(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")), benchmark, block_bytes=block_bytes)
    bad = settle(digest(found).where("contaminated").select(F.col("doc_id").alias("id")), "decontam-bad")
    return rows.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, "id", "left_anti").select("row.*")


def merged_spans(column: str) -> Column:
    """Disjoint spans covering the same words."""
    return F.expr(f"""
        aggregate(array_sort({column}), cast(array() as array<struct<start:bigint,end:bigint>>), (done, x) ->
            if(size(done) > 0 and element_at(done, -1).end >= x.start,
               concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, x.end)))),
               concat(done, array(x))))""")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the verdict that the query returns."""
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
