"""Language-model scoring with a compact n-gram trie of three levels.

The corpus is counted exactly: every word, every pair and every triple is a node.
The first level holds the words' values, the second the words that follow each,
the third the words that follow each pair. The children of a node are a run of the
next level, kept as context and word in one ascending sequence; the values, the
pointers to where a node's children begin and the children are Elias-Fano coded,
and a child is found by a successor search inside its context's run. Probabilities
are smoothed with count-wise discounts, each level's for the one below, and
quantised to a byte, as is what a context discounts.

Each level is built and written in shards of the first word's space by the tasks
that hold them, into the shared folder, and memory-mapped by the tasks that score;
neither the driver nor a task ever holds the whole.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .elias_fano import EliasFano
from .shared import fresh, mounted, shared_uri, small_batches
from .textops import U64

#: Log10 units of a byte of probability.
STEP = 0.05
#: Words that are counted (alone, in triples) or scored together, and rows of counts that are handed on at once.
WORD_WORDS = 2_500_000
COUNT_WORDS = 800_000
SCORE_WORDS = 500_000
COUNT_ROWS = 100_000
#: Shards for each partition of a shuffle, as a power of two: what a task sorts and writes is that much smaller.
SHARD_BITS = 2
#: Bits of a count that is handed on with its word in one number, whose rows are narrower to move and to sort.
COUNT_BITS = 24
ALIGN = 64
#: The end of a text, a token like any word and the context of a text's first.
END = U64(0x5DEECE66D1234567)
#: Discounts of counts 1, 2, and 3 or more of pairs and triples.
JOINT_DISCOUNTS = (0.5, 0.75, 0.75)

SCHEMA = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _tokens(batches: Iterator[pa.RecordBatch], column: str, words: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows, their tokens one after another and the bounds of each text's."""
    rows: list[pa.RecordBatch] = []
    parts: list[np.ndarray] = []
    ends: list[np.ndarray] = [np.zeros(1, np.int64)]
    total = 0
    for batch in textops.slices(batches, column):
        raw, at = textops.utf8(batch.column(batch.schema.get_field_index(column)))
        found = textops.Words(textops.lower(raw), at, textops.SPACED)
        values = np.insert(found.values(), found.first[1:], END)
        rows.append(batch)
        parts.append(values)
        ends.append(found.first[1:] + np.arange(1, batch.num_rows + 1) + total)
        total += len(values)
        if total >= words:
            yield rows, np.concatenate(parts), np.concatenate(ends)
            rows, parts, ends, total = [], [], [np.zeros(1, np.int64)], 0
    if rows:
        yield rows, np.concatenate(parts), np.concatenate(ends)


def _shard(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def _packed(word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and their counts as one number each, and the row of each; a count of more than ``COUNT_BITS`` takes several."""
    most = (1 << COUNT_BITS) - 1
    times = -(-n // most)
    row = np.repeat(np.arange(len(n)), times)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return word[row] << COUNT_BITS | np.minimum(n[row] - rank * most, most), row


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> COUNT_BITS, packed & ((1 << COUNT_BITS) - 1)


def _summed(runs: Iterator[tuple[list[np.ndarray], np.ndarray]], keys: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and total counts of one shard, from runs of both sorted by the keys."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(keys)]
    counts = [np.zeros(0, np.int64)]
    for k, n in runs:
        if not len(n):
            continue
        start = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in k], axis=0)]))
        k, n = [x[start] for x in k], np.add.reduceat(n, start)
        if len(counts[-1]) and all(f[-1][-1] == x[0] for f, x in zip(found, k, strict=True)):
            counts[-1][-1] += n[0]
            k, n = [x[1:] for x in k], n[1:]
        if len(n):
            for f, x in zip(found, k, strict=True):
                f.append(x)
            counts.append(n)
    return [np.concatenate(f) for f in found], np.concatenate(counts)


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as one file that appears whole; a repeated task writes the same again."""
    spec, at = {}, 0
    for part, array in arrays.items():
        spec[part] = (array.dtype.str, at, len(array))
        at += -(-array.nbytes // ALIGN) * ALIGN
    head = json.dumps(spec).encode()
    head += b" " * (-(len(head) + 8) % ALIGN)
    own = f"{folder}/{name}.{uuid.uuid4().hex}"  # copies of a task may run at once
    with open(own, "wb") as file:
        file.write(len(head).to_bytes(8, "little") + head)
        for array in arrays.values():
            file.write(np.ascontiguousarray(array).data)
            file.write(b" " * (-array.nbytes % ALIGN))
    os.replace(own, f"{folder}/{name}")


def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, as views of one mapping."""
    raw = np.asarray(np.memmap(f"{folder}/{name}", np.uint8, "r"))
    begin = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    spec = json.loads(raw[8:begin].tobytes())
    return {part: raw[begin + at : begin + at + n * np.dtype(kind).itemsize].view(kind) for part, (kind, at, n) in spec.items()}


def _sequence(prefix: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{prefix}_{k}": v for k, v in EliasFano.encode(values).arrays().items()}


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 255).astype(np.uint8)


def _discounted(n: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised log10 of each child's own mass (254 at most) and of what each context leaves to the level below."""
    total = np.maximum(np.bincount(context, n, contexts), 1)
    mass = (n - np.array([0.0, *JOINT_DISCOUNTS])[np.minimum(n, 3)]) / total[context]
    left = np.maximum(1 - np.bincount(context, mass, contexts), 1e-6)
    return np.minimum(_quantised(np.log10(np.maximum(mass, 1e-12))), 254), _quantised(np.log10(left))


@dataclass
class Trie:
    """Where the levels are, and the corpus figures that all shards share."""

    folder: str
    bits: int
    tokens: int
    words: int
    discounts: tuple[float, float, float]
    base: list[int]  # words of the shards before each

    def _level(self, shard: int, name: str, sequences: str, arrays: tuple[str, ...]) -> tuple:
        """The mapped sequences and arrays of a shard's level."""
        key = (self.folder, shard, name)
        if key not in _OPEN:
            if len(_OPEN) > 30_000:  # mappings that a process may have
                _OPEN.clear()
            got = _mapped(self.folder, f"{name}-{shard:05d}")
            _OPEN[key] = (*(EliasFano.of({p: got[f"{q}_{p}"] for p in EliasFano.PARTS}) for q in sequences), *(got[a] for a in arrays))
        return _OPEN[key]

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = shard.astype(np.int16) if self.bits < 15 else shard  # short numbers are sorted by their digits
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            yield s, order[bounds[s] : bounds[s + 1]]

    def counts(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in the corpus of word values, and their nodes (-1 without)."""
        count, node = np.zeros(len(values), np.int64), np.full(len(values), -1, np.int64)
        for s, at in self._by_shard(_shard(values, self.bits)):
            known, counts = self._level(s, "words", "v", ("counts",))
            place = known.find(values[at])
            hit = place >= 0
            count[at[hit]], node[at[hit]] = counts[place[hit]], place[hit] + self.base[s]
        return count, node

    def unseen(self) -> float:
        """Probability of each word that the corpus does not have."""
        return _spare(self.folder) / (self.words + 1)

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts])[np.minimum(count, 3)]
        return (count - d) / max(self.tokens, 1) + self.unseen()

    def pairs(self, shard: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of (context, word) nodes: places in the context's shard (-1 without), quantised own mass (255 without) and the context's backoff."""
        place, own, back = np.full(len(context), -1, np.int64), np.full(len(context), 255, np.uint8), np.zeros(len(context), np.uint8)
        for s, at in self._by_shard(shard):
            pointers, children, mass, backoff = self._level(s, "pairs", "pc", ("mass", "backoff"))
            local = context[at] - self.base[s]
            back[at] = backoff[local]
            # the context is the upper part of a child's value: the search stays in its run
            found = children.find(local.astype(U64) * U64(self.words) + word[at].astype(U64))
            hit = found >= 0
            place[at], own[at[hit]] = found, mass[found[hit]]
        return place, own, back

    def triples(self, shard: np.ndarray, pair: np.ndarray, word: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs (by shard and place) and words: quantised own mass (255 without) and the pair's backoff; only those ``there`` can have a node."""
        own, back = np.full(len(pair), 255, np.uint8), np.zeros(len(pair), np.uint8)
        for s, at in self._by_shard(shard):
            pointers, children, mass, backoff = self._level(s, "triples", "pc", ("mass", "backoff"))
            back[at] = backoff[pair[at]]
            at = at[there[at]]
            found = children.find(pair[at].astype(U64) * U64(self.words) + word[at].astype(U64))
            hit = found >= 0
            own[at[hit]] = mass[found[hit]]
        return own, back


_OPEN: dict = {}


def _spare(folder: str) -> float:
    key = (folder, "spare")
    if key not in _OPEN:
        _OPEN[key] = float(_mapped(folder, "spare")["spare"][0])
    return _OPEN[key]


def _handed(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), COUNT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + COUNT_ROWS]) for c in columns], names=names)


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, _ in _tokens(batches, "text", WORD_WORDS):
            codes, words = pd.factorize(values)
            n = np.bincount(codes, minlength=len(words))
            yield from _handed([_shard(words, bits).astype(np.int32), words.view(np.int64), n.astype(np.int64)], ["shard", "value", "n"])

    return run


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        (values,), n = _summed((([b.column("value").to_numpy()], b.column("n").to_numpy()) for b in batches), 1)
        order = np.argsort(values.view(U64))  # signed order within a shard is that of values, but for a single shard
        values, n = values.view(U64)[order], n[order]
        _write(folder, f"words-{shard:05d}", _sequence("v", values) | {"counts": n.astype(np.uint32 if n.max(initial=0) < 2**32 else np.int64)})
        some = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(values), int(n.sum()), *some)], names=["shard", "words", "tokens", "n1", "n2", "n3", "n4"])

    return run


def _nodes_of(trie: Trie, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code of each token, and the distinct words' values, counts and nodes."""
    codes, words = pd.factorize(values)
    order = np.argsort(words)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = words[order]
    return rank[codes], words, *trie.counts(words)


def _before(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Code of the token before each; a text's first follows an end."""
    end = np.searchsorted(words, END)
    return np.concatenate([[end], codes[:-1]])


def _count_joint(trie: Trie):
    """Counts of (pair, next word), word and count in one number; the end has no next word, which the number of words stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, _ in _tokens(batches, "text", COUNT_WORDS):
            codes, words, _, nodes = _nodes_of(trie, values)
            size, end = len(words) + 1, np.searchsorted(words, END)
            after = np.where(codes == end, size - 1, np.append(codes[1:], size - 1))
            before = _before(codes, words)
            if size < 1 << 21:  # three codes fit in a word
                key = np.sort((before * size + codes) * size + after)
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                key = key[start]
                pair = key // size  # a division by one number is fast, divmod is not
                u = pair // size
                v, w = pair - u * size, key - pair * size
            else:
                order = np.lexsort((after, codes, before))
                u, v, w = before[order], codes[order], after[order]
                start = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
                u, v, w = u[start], v[start], w[start]
            n = np.diff(np.append(start, len(codes)))
            nodes = np.append(nodes, trie.words)
            following, row = _packed(nodes[w], n)
            u, v = u[row], v[row]
            yield from _handed([_shard(words, trie.bits).astype(np.int32)[u], nodes[u] * trie.words + nodes[v], following], ["shard", "pair", "next"])

    return run


def _write_joint(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        parts = ((b.column("pair").to_numpy(), *_unpacked(b.column("next").to_numpy())) for b in batches)
        (pair, word), n = _summed((([pair, word], n) for pair, word, n in parts), 2)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
        children = pair[first] - trie.base[shard] * trie.words
        own, context = trie.base[shard + 1] - trie.base[shard], children // max(trie.words, 1)
        mass, back = _discounted(np.add.reduceat(n, first) if len(n) else n, context, own)
        pointers = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=own))])
        _write(trie.folder, f"pairs-{shard:05d}", _sequence("p", pointers) | _sequence("c", children) | {"mass": mass, "backoff": back})
        has = word < trie.words
        of, word, n = of[has], word[has], n[has]
        mass, back = _discounted(n, of, len(first))
        pointers = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(first)))])
        _write(trie.folder, f"triples-{shard:05d}", _sequence("p", pointers) | _sequence("c", of * trie.words + word) | {"mass": mass, "backoff": back})
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(first), len(word))], names=["shard", "pairs", "triples"])

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more, from counts of counts."""
    if not (n1 and n2 and n3):
        return (0.5, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def build(corpus: DataFrame) -> Trie:
    """Count ``corpus`` (text; null is empty) and write the trie into the shared folder.

    An empty corpus gives a trie without words, under which all words are equally
    unknown. Repeated rows count each time.
    """
    spark = corpus.sparkSession
    shared_uri(spark)
    folder = mounted(fresh(spark, "trie"))
    os.makedirs(folder)
    bits = max(0, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length() - 1) + SHARD_BITS
    texts = small_batches(corpus).select(F.col("text").cast("string").alias("text"))
    words = texts.mapInArrow(_count_words(bits), "shard int, value long, n long").repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("value").select("value", "n")
    rows = sorted(words.mapInArrow(_write_words(folder), "shard long, words long, tokens long, n1 long, n2 long, n3 long, n4 long").collect())  # a row for each shard
    some = [sum(r[f"n{k}"] for r in rows) for k in (1, 2, 3, 4)]
    of = {r["shard"]: r["words"] for r in rows}
    base = [0]
    for shard in range(1 << bits):
        if shard not in of:  # an empty corpus runs no task
            _write(folder, f"words-{shard:05d}", _sequence("v", np.zeros(0, U64)) | {"counts": np.zeros(0, np.uint32)})
        base.append(base[-1] + of.get(shard, 0))
    discounts = _discounts(*some)
    tokens, kinds = sum(r["tokens"] for r in rows), sum(r["words"] for r in rows)
    counted = (some[0], some[1], kinds - some[0] - some[1])
    spare = sum(d * n for d, n in zip(discounts, counted, strict=True)) / tokens if tokens else 1.0
    _write(folder, "spare", {"spare": np.array([spare])})
    trie = Trie(folder, bits, tokens, kinds, discounts, base)
    joint = texts.mapInArrow(_count_joint(trie), "shard int, pair long, next long").repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("pair", "next").select("pair", "next")
    joint.mapInArrow(_write_joint(trie), "shard long, pairs long, triples long").collect()
    return trie


#: What quantised masses stand for.
_MASSES = 10.0 ** (-STEP * np.arange(256.0))


def _mixed(own: np.ndarray, back: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log10 of own mass (quantised, 255 for none) and of what the context leaves to ``below``."""
    out = below - STEP * back
    some = np.flatnonzero(own < 255)
    out[some] = np.log10(_MASSES[own[some]] + 10.0 ** out[some])
    return out


def _score(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, values, first in _tokens(batches, "text", SCORE_WORDS):
            codes, words, count, nodes = _nodes_of(trie, values)
            start = first[:-1]
            base = np.log10((count + 1) / (trie.tokens + (trie.words + 1)))
            log = -STEP * _quantised(np.log10(trie.word_probability(count)))
            before = _before(codes, words)
            shards = _shard(words, trie.bits)
            # distinct pairs of a known context: where they are, and their probability
            which, distinct = pd.factorize(before * np.int64(len(words)) + codes)
            h = distinct // len(words)
            w = distinct - h * len(words)
            two, place = log[w].astype(np.float64), np.full(len(distinct), -1, np.int64)
            has = np.flatnonzero(nodes[h] >= 0)
            if len(has):
                known = nodes[w[has]] >= 0
                place[has], own, back = trie.pairs(shards[h[has]], nodes[h[has]], np.maximum(nodes[w[has]], 0))
                place[has[~known]] = -1
                two[has] = _mixed(np.where(known, own, 255), back, two[has])
            each = two[which]
            # a text's first word has no pair before it
            pair = np.full(len(codes), -1, np.int64)
            pair[1:] = place[which[:-1]]
            pair[start] = -1
            at = np.flatnonzero(pair >= 0)
            if len(at):
                own, back = trie.triples(shards[before[at - 1]], pair[at], np.maximum(nodes[codes[at]], 0), place[which[at]] >= 0)
                each[at] = _mixed(own, back, each[at])
            known = count > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.chunked_array([r.column(0) for r in rows]).combine_chunks(), pa.array(np.diff(first)), pa.array(np.add.reduceat(known[codes].astype(np.int64), start)),
                    pa.array(np.full(len(start), trie.tokens)), pa.array(np.add.reduceat(base[codes], start)), pa.array(np.add.reduceat(each, start)),
                ], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """Token counts, add-one base score and log10 probability of each row of ``docs`` (doc_id, text).

    A null text is empty: its end is its one token. Whole texts are scored, rows
    each for itself; other columns are ignored.
    """
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_score(trie), SCHEMA)
