"""Exact n-gram Jaccard join in metric space.

Jaccard distance over word shingles is a metric, and over any hash class of the
shingle universe it is one again. Random documents are useless as pivots there:
unrelated texts share no shingle, so nearly all lie at distance 1 from every
pivot and the windows would copy everything everywhere. The pivots are therefore
taken in the classes:

* The empty set is the first pivot. By the triangle inequality for the symmetric
  difference two linked sets differ in size by their difference at most, so sets
  fall in bands of size and those in the window at a band's foot are copied to
  the band below.
* In a band the universe is split in hash classes, more than a linked pair can
  differ in. Sets that are at distance 0 in a class form one Voronoi region of
  it. A set enters as many of its non-empty classes as it may have differences,
  and one more: linked sets then share a region, as one class at least holds no
  difference.
* The smallest set of a region is its pivot. Distances to the pivots are
  measured; pairs around a pivot that are not joined yet are searched again,
  the nearest first and then all, keeping those that the triangle inequality over parity sketches (each
  element flips one bit, so sketches differ in no more bits than the sets in
  elements) leaves possible, and are measured in turn.

Nothing is sampled or capped, no text is compared with all others, and links are
found up to connectivity: all classes are those of the full link graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .components import components
from .shared import settle, small_batches
from .textops import U64

#: Words of a shingle; linked when 100 * intersection >= PERCENT * union.
GRAM = 4
PERCENT = 85
#: Bits of a shingle's value; the rest of a word holds the text's place in its slice.
BITS = 52
_LOW = U64((1 << BITS) - 1)
#: Class families that a set of too few classes enters.
FAMILIES = 4
#: Members of a region that are searched together.
REGION_ROWS = 1024
#: Pairs of each set that are measured before all others.
NEAREST = (2, 8)
#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 1_000_000


def shingles(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle values, ascending in each text, and the bounds of each text's."""
    raw, at = textops.utf8(texts)
    words = textops.Words(textops.lower(raw), at, textops.SPACED)
    values, count = words.values(), words.count
    got, index = textops.grams(values, words.first, gram)
    owner = np.searchsorted(words.first, index, "right") - 1
    for short in range(1, gram):
        few = np.flatnonzero(count == short)
        if len(few):
            whole = values[words.first[few]]
            for j in range(1, short):
                whole = whole * U64(0x9E3779B97F4A7C15) + values[words.first[few] + j]
            got, owner = np.concatenate([got, textops.mix(whole ^ U64(short))]), np.concatenate([owner, few])
    packed = np.sort((owner.astype(U64) << U64(BITS)) | (got >> U64(64 - BITS)))
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    return packed & _LOW, np.searchsorted(packed >> U64(BITS), np.arange(len(at)))


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets."""
    total = np.concatenate([[U64(0)], np.cumsum(textops.mix(values + U64(0x51ED270B)))])
    return textops.mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(U64))


def allowed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Differences that a set of n elements may have from a linked one."""
    return n * (100 - percent) // percent


def regions(values: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(text, region) of all regions that the sets enter."""
    n = np.diff(first)
    band = np.zeros(len(n), np.int64)
    band[n > 0] = np.floor(np.log2(n[n > 0])).astype(np.int64)
    out = []
    for below in (0, 1):
        level = band - below
        # sets whose smallest linked partner is in the band below, and that may differ at all
        pick = np.flatnonzero((allowed(n, percent) > 0) & (n > 0) & (level >= 0) & ((below == 0) | (percent * n < (100 << np.minimum(band, 50)))))
        family = 0
        while len(pick):
            top = (2 << level[pick]) - 1
            differ = np.minimum(allowed(n[pick], percent), allowed(top, percent))
            if below:
                keep = differ > 0
                pick, top, differ = pick[keep], top[keep], differ[keep]
            classes = allowed(top, percent) * 5 // 4 + 2
            base = np.concatenate([[0], np.cumsum(classes)])
            size = n[pick]
            where = np.repeat(np.arange(len(pick)), size)
            element = values[np.repeat(first[pick] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(pick) else values[:0]
            hashed = textops.mix(element ^ U64(0xC2B2AE3D27D4EB4F * (family + 1) & (1 << 64) - 1))
            cell = base[where] + ((hashed >> U64(32)) * classes[where].astype(U64) >> U64(32)).astype(np.int64)
            content = np.zeros(base[-1], U64)
            np.add.at(content, cell, textops.mix(hashed))
            filled = np.bincount(cell, minlength=base[-1]) > 0
            rank = np.cumsum(filled)
            row = np.repeat(np.arange(len(pick)), classes)
            before = np.concatenate([[0], rank])[base[:-1]]
            kept = np.flatnonzero(filled & (rank - before[row] <= differ[row] + 1))
            name = content[kept] ^ textops.mix((kept - base[row[kept]]).astype(U64) + (level[pick][row[kept]].astype(U64) << U64(32)) + (U64(family) << U64(48)))
            out.append((pick[row[kept]], textops.mix(name)))
            # too few classes: further families, and in the end one region of all such sets
            enough = np.bincount(row[filled], minlength=len(pick)) >= differ + 1
            pick = pick[~enough]
            family += 1
            if family == FAMILIES:
                out.append((pick, textops.mix(level[pick].astype(U64) + U64(7))))
                break
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a sketch: the power of two from half the size on, 64 at least."""
    return np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def sketches(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parities of each set's elements over hash bits."""
    bits = _sketch_bits(np.diff(first))
    base = np.concatenate([[0], np.cumsum(1 << bits)])
    row = np.repeat(np.arange(len(bits)), np.diff(first))
    place = base[row] + (textops.mix(values ^ U64(0x2545F4914F6CDD1D)) & ((U64(1) << bits[row].astype(U64)) - U64(1))).astype(np.int64)
    odd = (np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8)
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch over fewer bits: halves of a parity add up."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > size:
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return x


def possible(n_a: int, n_b: int, a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """Whether sizes and sketches leave two sets a chance to be linked."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return differ * (100 + percent) <= (100 - percent) * (n_a + n_b)


def _describe(gram: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in textops.slices(batches, rows=4000):
            values, first = shingles(batch.column(1), gram)
            n, keys = np.diff(first), set_keys(values, first)
            # a copy in the same task enters no region again; a row without id stands for none
            fresh, named = np.zeros(len(n), bool), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, k in enumerate(keys.tolist()):
                if n[i] and named[i] and k not in seen:
                    fresh[i] = True
                    seen.add(k)
            if len(seen) > 500_000:
                seen.clear()
            text, region = regions(values, first, percent)
            own = fresh[text]
            text, region = text[own], region[own]
            order = np.argsort(text, kind="stable")
            bounds = np.searchsorted(text[order], np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(keys.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(region[order].view(np.int64))), pa.array(sketches(values, first), pa.binary())],
                names=["doc_id", "n", "key", "regions", "sketch"],
            )

    return run


def _with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by region and key, those of regions with several sets, with the pivot: the first."""
    region = pivot = last = None
    for batch in batches:
        r, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(r):
            continue
        new = np.ones(len(r), bool)
        new[1:] = r[1:] != r[:-1]
        again = np.zeros(len(r), bool)
        again[1:] = ~new[1:] & (k[1:] == k[:-1])
        if region is not None and r[0] == region:
            new[0] = False
            again[0] = k[0] == last
        start = np.maximum.accumulate(np.where(new, np.arange(len(r)), -1))
        lead = np.where(start >= 0, k[start], pivot if pivot is not None else 0)
        region, pivot, last = r[-1], lead[-1], k[-1]
        out = np.flatnonzero(~again & (k != lead))
        yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(lead[out])], names=["key", "pivot"])


def _prune(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True)
            keep = pa.array([possible(*x, percent) for x in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return run


def _emit_sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, rows=4000):
            values, first = shingles(batch.column(batch.schema.get_field_index("text")), gram)
            keys = set_keys(values, first).view(np.int64)
            heads = batch.column(2)
            many = np.where(keys == batch.column(1).to_numpy(), np.diff(heads.offsets.to_numpy()), 0)
            head = heads.flatten().to_numpy()
            before = heads.offsets.to_numpy() - heads.offsets.to_numpy()[0]
            data, cut = values.tobytes(), (first * 8).tolist()
            upto = np.cumsum(many)
            for a in range(0, int(upto[-1]) if len(upto) else 0, 256):
                pair = np.arange(a, min(a + 256, int(upto[-1])))
                i = np.searchsorted(upto, pair, "right")
                to = head[before[i] + pair - (upto[i] - many[i])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), pa.array(keys[i]), pa.array(keys[i] != to), pa.array([data[cut[x] : cut[x + 1]] for x in i.tolist()], pa.binary())],
                    names=["b", "a", "member", "elements"],
                )

    return run


def _measure(percent: int):
    """Of rows sorted by pivot with its own set first, the members that are linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, last = None, None, None
        for batch in batches:
            found = []
            for b, a, member, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if not member:
                    head, own, last = b, np.frombuffer(data, U64), None
                elif b == head and a != last:
                    last, other = a, np.frombuffer(data, U64)
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[at] == other).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return run


def _search(percent: int, nearest: int | None):
    """Possible pairs of a region that are in different components, from rows sorted by region and tile."""

    def pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        _, _, left, right, key, component, n, sketch = zip(*rows, strict=True)
        key, component, n = np.array(key), np.array(component), np.array(n)
        size = min(map(len, sketch))
        bits = np.stack([folded(x, size) for x in sketch])
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        differ = np.zeros((len(i), len(j)), np.uint32)
        for word in range(bits.shape[1]):
            differ += np.bitwise_count(bits[i, word][:, None] ^ bits[j, word][None])
        a, b = n[i][:, None], n[j][None]
        good = (differ * (100 + percent) <= (100 - percent) * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (component[i][:, None] != component[j][None])
        if nearest is not None and len(j) > nearest:
            far = np.where(good, differ, np.iinfo(np.uint32).max)
            kept = np.argpartition(far, nearest, axis=1)[:, :nearest]
            some = np.zeros_like(good)
            np.put_along_axis(some, kept, True, 1)
            good &= some
        x, y = np.nonzero(good)
        x, y = key[i[x]], key[j[y]]
        return np.minimum(x, y), np.maximum(x, y)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = np.unique(np.stack(pairs(rows), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] != name:
                    if len(held) > 1:
                        yield flush(held)
                    held, name = [], row[:2]
                held.append(row)
        if len(held) > 1:
            yield flush(held)

    return run


class JaccardJoin:
    """The stages of the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, gram: int = GRAM, percent: int = PERCENT):
        self.gram, self.percent = gram, percent
        self.docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        described = self.docs.mapInArrow(_describe(gram, percent), "doc_id long, n long, key long, regions array<long>, sketch binary")
        self.described = settle(described, "jaccard-described")
        self.sets = settle(
            self.described.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")),
            "jaccard-sets",
        )

    def members(self) -> DataFrame:
        """(key, pivot): the sets of each pivot's regions, pivots aside."""
        rows = self.described.where("n > 0 and doc_id is not null").select(F.explode("regions").alias("region"), "key")
        rows = rows.repartition(self.parts, "region").sortWithinPartitions("region", "key").mapInArrow(_with_pivots, "key long, pivot long")
        return settle(rows.distinct(), "jaccard-members")

    def pruned(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that sizes and sketches leave possible."""
        side = {x: self.sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"}
        rows = pairs.join(side["a"], "a").join(side["b"], "b").where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        return rows.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_prune(self.percent), "a long, b long")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose sets are linked, by the sets themselves."""
        heads = pairs.select(F.col("a").alias("key"), F.col("b").alias("head")).unionByName(pairs.select(F.col("b").alias("key"), F.col("b").alias("head")))
        wanted = heads.groupBy("key").agg(F.collect_set("head").alias("heads")).join(self.sets.select("key", "doc_id"), "key").select("doc_id", "key", "heads")
        wanted = settle(wanted, "jaccard-wanted")
        cells = wanted.agg(F.sum(F.size("heads") + 2)).first()[0] or 0
        side = F.broadcast(wanted) if cells <= BROADCAST_ROWS else wanted
        rows = self.docs.join(side, "doc_id").select("doc_id", "key", "heads", "text").mapInArrow(_emit_sets(self.gram), "b long, a long, member boolean, elements binary")
        return rows.repartition(self.parts, "b").sortWithinPartitions("b", "member", "a").mapInArrow(_measure(self.percent), "a long, b long")

    def beyond_pivots(self, members: DataFrame, found: DataFrame, nearest: int | None) -> DataFrame:
        """Pairs of a pivot's sets that are in different components so far and possible; of each set all, or the nearest."""
        rows = members.select(F.col("pivot").alias("region"), "key").unionByName(members.select(F.col("pivot").alias("region"), F.col("pivot").alias("key")).distinct())
        rows = rows.join(found.select("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        mixed = rows.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")).where("low <> high and rows > 2").select("region", "rows")
        rows = rows.join(mixed, "region").join(self.sets.select("key", "n", "sketch"), "key")
        rows = rows.withColumn("tiles", F.ceil(F.col("rows") / REGION_ROWS)).withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")))
        # a large region is searched tile by tile: each pair of its parts is one tile
        tile = F.expr("transform(sequence(0L, tiles - 1), x -> struct(least(own, x) * tiles + greatest(own, x) as tile, own <= x as left, own >= x as right))")
        rows = rows.select("region", F.explode(tile).alias("at"), "key", "component", "n", "sketch").select("region", "at.tile", "at.left", "at.right", "key", "component", "n", "sketch")
        return settle(rows.repartition(self.parts, "region", "tile").sortWithinPartitions("region", "tile").mapInArrow(_search(self.percent, nearest), "a long, b long").distinct(), "jaccard-pairs")

    def classes(self) -> DataFrame:
        """(key, component) of sets that are linked with another."""
        members = self.members()
        links = settle(self.linked(settle(self.pruned(members.select(F.col("key").alias("a"), F.col("pivot").alias("b"))), "jaccard-pairs")), "jaccard-links")
        found = components(links)
        # near ones first: once they are joined, few pairs of different components are left to measure
        for nearest in (*NEAREST, None):
            pairs = self.beyond_pivots(members, found, nearest)
            if pairs.isEmpty():
                break
            links = settle(links.unionByName(self.linked(pairs)), "jaccard-links")
            found = components(links)
        return found


def jaccard_components(docs: DataFrame, *, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text).

    Words are lower-cased over A-Z and end at ASCII white space. A text of fewer
    words than a shingle is one shingle; a null or wordless text has none and is
    its own component. Equal sets are one node, so copies cost one row. A row
    without doc_id has no component. Rows of one doc_id are judged each for
    itself; an empty table gives no rows; other columns are ignored.
    """
    join = JaccardJoin(docs, gram, percent)
    found = join.classes()
    named = join.sets.select("key", "doc_id").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("key", "component_id")
    return (
        join.described.select("doc_id", "n", "key")
        .join(named, "key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, *, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; all columns as they were.

    Rows without words stay. Where ids repeat or are missing, rows are told apart
    by a written row number, and the smallest of that stays.
    """
    unique = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id")) if unique else settle(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "jaccard-rows")
    found = jaccard_components(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")), gram=gram, percent=percent)
    copies = settle(found.where("component_id <> doc_id").select(F.col("doc_id").alias("id")), "jaccard-copies")
    return rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "id", "left_anti").select("row.*")
