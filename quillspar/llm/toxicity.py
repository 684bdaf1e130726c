"""Toxicity by two Kneser-Ney bigram models, one of each class, over shared backoff counts.

Learned from labelled texts. Every level counts an expression once for each word
it follows (continuation counts), so copies of a text add nothing. A count n is
discounted by d = min(n, t + sqrt(e) + D), where e is what both classes' counts
together lead to expect of the class, and t what they would if its odds were TILT
times as high: chance, and a mix of languages or topics that differs between the
classes, is taken off with the constant. All that is discounted goes to the level
below, so each model is a distribution that sums to one:

* word after word: (n - d) / total of the context + what it discounts x p(word); e
  is the larger of both classes' share and of the class's own p(word),
* p(word): (k - d) / total + what it discounts x q(word),
* q(word): the discounts of both classes, discounted by D once more towards a
  uniform share, which is also what a word of neither class gets.

An expression that is rare, or as frequent in both classes, is thus left to the
shared counts q and weighs nearly the same in both models; the toxic and the
ordinary log-likelihood of a text, each divided by its number of words, are
compared by their difference. A monotone calibration on out-of-fold differences,
both classes weighed alike, puts that on the scale of a probability.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import small_batches
from .textops import U64

#: Labelled texts of each class that are learned from, at most, and their UTF-8 bytes.
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 16 << 20
#: Constant discounts of a word's and of a bigram's continuation count.
WORD_DISCOUNT = 0.75
PAIR_DISCOUNT = 1.5
#: Odds of a class, as a multiple of its odds over all, that say nothing yet.
TILT = 2.0
FOLDS = 4
#: Parts in which bigrams are counted.
COUNT_PARTS = 8
REJECT_FROM = 0.7

SCHEMA = "doc_id long, score double, n_words long, ordinary_log double, toxic_log double, log_ratio double"
_PAIR = U64(0x9E3779B97F4A7C15)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word values, the value before each (0 at a text's start) and the words' bounds."""
    parts, firsts = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for batch in textops.slices([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        raw, at = textops.utf8(batch.column(0))
        words = textops.Words(textops.lower(raw), at, textops.ALNUM)
        parts.append(words.values())
        firsts.append(words.first[1:] + firsts[-1][-1])
    values, first = np.concatenate(parts), np.concatenate(firsts)
    before = np.zeros(len(values), U64)
    before[1:] = values[:-1]
    begin = first[:-1]
    before[begin[begin < len(values)]] = 0
    return values, before, first


def _lookup(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return i, table[i] == x


def _discount(n: np.ndarray, expected: np.ndarray, tilted: np.ndarray, constant: float) -> np.ndarray:
    return np.minimum(n, tilted + np.sqrt(expected) + constant)


def _tilt(expected: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What a class with ``share`` of all would be expected to have if its odds were TILT times as high."""
    return TILT * expected / (1 + (TILT - 1) * share)


@dataclass
class KneserNeyPair:
    """Two class models over one vocabulary; arrays have a row for each class (ordinary, toxic)."""

    words: np.ndarray
    lower: np.ndarray  # 2 x words: log p(word)
    unseen: np.ndarray  # 2: the same for a word of neither class
    spare: np.ndarray  # 2 x (words + 1): log of what a context discounts, last the start and unknown contexts
    pairs: np.ndarray  # the bigrams of which a class keeps something
    higher: np.ndarray  # 2 x pairs: log p(word | word before)
    knots: np.ndarray
    levels: np.ndarray

    @classmethod
    def fit(cls, words: np.ndarray, word: np.ndarray, begins: np.ndarray, toxic: np.ndarray) -> KneserNeyPair:
        """words: distinct values in order; word, begins, toxic: of each token its place there, whether a text begins and the class."""
        there = np.bincount(word, minlength=len(words)) > 0
        words, word = words[there], (np.cumsum(there, dtype=np.int32) - 1)[word]
        size = len(words)
        if not size:
            none = np.zeros((2, 0))
            return cls(words, none, np.zeros(2), np.zeros((2, 1)), words, none, np.zeros(1), np.zeros(1))
        before = np.full(len(word), size, np.int32)  # size: none
        before[1:] = word[:-1]
        before[begins] = size
        two_before = np.full(len(word), size, np.int32)
        two_before[1:] = before[:-1]
        two_before[begins] = size
        pairs, counts = [], []
        for part in range(COUNT_PARTS):  # in parts, to hold less at once
            own = np.nonzero(word % COUNT_PARTS == part)[0]
            pair, at = np.unique(before[own] * np.int64(size) + word[own], return_inverse=True)
            n = np.zeros((2, len(pair)), np.float32)
            for c in (0, 1):
                mine = toxic[own] == c
                grams = np.unique(at[mine] * np.int64(size + 1) + two_before[own[mine]])
                n[c] = np.bincount(grams // (size + 1), minlength=len(pair))
            pairs.append(pair)
            counts.append(n)
        pair, n = np.concatenate(pairs), np.concatenate(counts, axis=1)
        del before, two_before, pairs, counts, at, grams
        context, word = (x.astype(np.int32) for x in np.divmod(pair, size))
        # words: a class's continuation counts over shared ones
        k = np.stack([np.bincount(word, n[c] > 0, size) for c in (0, 1)])
        total = np.maximum(k.sum(1, keepdims=True), 1)
        expected = total * k.sum(0) / total.sum()
        taken = _discount(k, expected, _tilt(expected, total / total.sum()), WORD_DISCOUNT)
        shared = taken.sum(0)
        kept = np.maximum(shared - WORD_DISCOUNT, 0) / shared.sum()
        uniform = (1 - kept.sum()) / (size + 1)
        own_part = taken.sum(1, keepdims=True) / total
        own_part[k.sum(1) == 0] = 1
        lower = (k - taken) / total + own_part * (kept + uniform)
        # bigrams: over what both classes, and the class's words alone, lead to expect
        mass = np.stack([np.bincount(context, n[c], size + 1) for c in (0, 1)])
        share, alone = (mass / np.maximum(mass.sum(0), 1))[:, context], mass[:, context] * lower[:, word]
        expected = share * n.sum(0)
        taken = _discount(n, np.maximum(expected, alone), np.maximum(_tilt(expected, share), TILT * alone), PAIR_DISCOUNT)
        del share, alone, expected
        spare = np.stack([np.bincount(context, taken[c], size + 1) for c in (0, 1)]) / np.maximum(mass, 1)
        spare[mass == 0] = 1
        strong = (n > taken).any(0)
        context, word = context[strong], word[strong]
        higher = (n - taken)[:, strong] / np.maximum(mass[:, context], 1) + spare[:, context] * lower[:, word]
        pairs = textops.mix(np.append(words, U64(0))[context] * _PAIR + words[word])
        order = np.argsort(pairs)
        return cls(words, np.log(lower), np.log(own_part[:, 0] * uniform), np.log(spare), pairs[order], np.log(higher[:, order]), np.zeros(1), np.zeros(1))

    def log_likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """2 x texts: each class's log-likelihood over the number of words (of an unknown word, if there is none), and that number."""
        values, before, first = _tokens(texts)
        codes, distinct = pd.factorize(values)
        i, known = _lookup(self.words, distinct)
        lower = np.where(known, self.lower[:, i] if len(self.words) else 0.0, self.unseen[:, None])
        i, known = _lookup(self.words, before)
        each = lower[:, codes] + self.spare[:, np.where(known, i, len(self.words))]
        i, known = _lookup(self.pairs, textops.mix(before * _PAIR + values))
        if known.any():
            each[:, known] = self.higher[:, i[known]]
        sums = np.concatenate([np.zeros((2, 1)), np.cumsum(each, axis=1, dtype=float)], axis=1)
        count = np.diff(first)
        return np.where(count > 0, (sums[:, first[1:]] - sums[:, first[:-1]]) / np.maximum(count, 1), self.unseen[:, None]), count

    def log_ratios(self, texts: pa.Array) -> np.ndarray:
        """Toxic less ordinary length-normalised log-likelihood of each text."""
        ordinary, toxic = self.log_likelihoods(texts)[0]
        return toxic - ordinary

    def score(self, ratio: np.ndarray) -> np.ndarray:
        """The calibrated level, with a hundredth left for the order within a level."""
        return 0.99 * np.interp(ratio, self.knots, self.levels) + 0.01 / (1 + np.exp(-np.clip(ratio, -30, 30)))


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (both ends of each step) and levels of the increasing step function nearest to y (pooled adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weighted y, weight, first and last x
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([b * w, w, a, a])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    return np.array([x for b in blocks for x in b[2:]]), np.repeat([b[0] / b[1] for b in blocks], 2)


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> KneserNeyPair:
    """Fit both models and the calibration on texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks.

    At most ``sample_rows`` labelled rows of each class are drawn, by a hash of
    doc_id, and of these the first by that hash whose whole texts come to
    ``sample_bytes``. Labels without doc_id or toxic, and texts that are null,
    teach nothing; of repeated labels the toxic one counts; equal texts teach
    once and stay in one fold. Without texts of both classes every score is the
    share of toxic labels (0 without labels).
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, float(sample_rows) / n)]) if counts else None
    none = KneserNeyPair.fit(np.zeros(0, U64), *[np.zeros(0, np.int32)] * 3)
    none.levels = np.array([counts.get(1, 0) / max(1, sum(counts.values()))])
    if len(counts) < 2:
        return none
    unit = (F.xxhash64("doc_id").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    drawn = marked.where(unit < share[F.col("toxic")]).orderBy(F.xxhash64("doc_id")).limit(3 * sample_rows)
    known = spark.createDataFrame([tuple(r) for r in drawn.collect()], "doc_id long, toxic int")  # bounded
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(known), "doc_id")
    # the sample is bounded, so one task can fit it; the driver gets the model alone
    drawn = rows.select(F.xxhash64("doc_id").alias("rank"), "toxic", "text")
    got = drawn.repartition(1).mapInArrow(_fitted(sample_bytes), "model binary").collect()
    return pickle.loads(got[0][0]) if got else none


def _sample(batches: Iterator[pa.RecordBatch], sample_bytes: int) -> list[list[bytes]]:
    """Distinct texts of each class, the first by rank that come to sample_bytes; never holds more but for one text."""
    held: list[list[tuple[int, bytes]]] = [[], []]
    bulk = [0, 0]
    for batch in batches:
        for rank, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            heapq.heappush(held[toxic], (-rank, text))
            bulk[toxic] += len(text)
            while bulk[toxic] > sample_bytes and len(held[toxic]) > 1:
                bulk[toxic] -= len(heapq.heappop(held[toxic])[1])
    return [sorted({text for _, text in each}) for each in held]


def _fitted(sample_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _sample(batches, sample_bytes)
        if not all(texts):
            return
        toxic = np.repeat([0, 1], [len(t) for t in texts])
        fold = np.array([zlib.crc32(t) % FOLDS for each in texts for t in each])
        texts = pa.array(texts[0] + texts[1], pa.binary()).cast(pa.string())
        values, before, first = _tokens(texts)
        n, begins = np.diff(first), before == 0
        words = np.unique(values)
        word = np.searchsorted(words, values).astype(np.int32)
        del values, before
        fit = lambda rows: KneserNeyPair.fit(words, *(x[np.repeat(rows, n)] for x in (word, begins, np.repeat(toxic == 1, n))))
        ratio = np.zeros(len(toxic))
        for k in range(FOLDS):
            out = fold == k
            if out.any() and not out.all():
                ratio[out] = fit(~out).log_ratios(texts.filter(pa.array(out)))
        model = fit(np.ones(len(toxic), bool))
        model.knots, model.levels = monotone(ratio, toxic.astype(float), 1.0 / np.bincount(toxic)[toxic])
        for name in ("lower", "spare", "higher"):
            setattr(model, name, getattr(model, name).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def toxicity(docs: DataFrame, model: KneserNeyPair) -> DataFrame:
    """score (0 to 1), words and length-normalised log-likelihoods of each row of ``docs`` (doc_id, text).

    Whole texts are scored. A null or wordless text has the likelihoods of one
    unknown word. Repeated rows are scored each for itself; other columns are
    ignored, whatever their names. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the learning sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches):
            (ordinary, toxic), count = shared.value.log_likelihoods(batch.column(1))
            ratio = toxic - ordinary
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (shared.value.score(ratio), count.astype(np.int64), ordinary, toxic, ratio))], names=["doc_id", "score", "n_words", "ordinary_log", "toxic_log", "log_ratio"]
            )

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, model: KneserNeyPair, *, reject_from: float = REJECT_FROM) -> DataFrame:
    """Rows of ``docs`` that score below ``reject_from``, all columns as they were.

    Rows without text or words score as one unknown word does; repeated rows stay
    or go together. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches):
            ratio = shared.value.log_ratios(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(shared.value.score(ratio) < reject_from))

    return small_batches(docs).mapInArrow(run, docs.schema)
