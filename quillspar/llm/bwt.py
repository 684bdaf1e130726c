"""Burrows-Wheeler transforms of text shards, merged by interleave refinement.

Each shard's transform is built alone. Merging keeps one array that says from
which shard each row of the merged transform comes; a pass over it deals the
shards' symbols out in stable order and so refines the interleave by one symbol
of context, without sorting any suffix again. Where two neighbours first part is
their common prefix; after as many passes as a string is long, rows that have not
parted from a neighbour are its repeated intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ShardTransform:
    """Symbols before each suffix in suffix order (0 ends a text), and where the suffixes start."""

    symbols: np.ndarray
    starts: np.ndarray
    texts: int


def _stable(keys: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative keys, by one sort of keys and places together."""
    return np.sort(keys.astype(np.int64) << 32 | np.arange(len(keys))) & 0xFFFFFFFF


def transform(data: np.ndarray) -> ShardTransform:
    """Of symbols from 1 on, each text closed by a 0, by prefix doubling; ends differ from one another, in text order."""
    data = np.asarray(data, np.int64)
    n = len(data)
    ends = np.flatnonzero(data == 0)
    rank = data + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank << 32 | after
        order = np.argsort(key)
        key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        step *= 2
    before = np.concatenate([[0], data[:-1]])
    return ShardTransform(before[order], order, len(ends))


def merged(shards: list[ShardTransform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave after ``depth`` passes, and each row's common prefix with the row before (depth: that or more)."""
    sizes = np.array([len(s.symbols) for s in shards])
    symbols = np.concatenate([s.symbols for s in shards])
    texts = np.array([s.texts for s in shards])
    ends = int(texts.sum())
    heads = np.repeat(np.arange(len(shards), dtype=np.uint16), texts)
    source = np.concatenate([heads, np.repeat(np.arange(len(shards), dtype=np.uint16), sizes - texts)])
    parted = np.zeros(len(source), bool)
    parted[:1] = True
    common = np.full(len(source), depth, np.int64)
    common[:1] = 0
    for done in range(depth):
        place = np.empty(len(source), np.int64)
        place[np.argsort(source, kind="stable")] = np.arange(len(source))  # rows of a shard keep their own order
        symbol = symbols[place]
        block = np.cumsum(parted)
        deal = _stable(symbol)[ends:]  # ends stay in text order
        source = np.concatenate([heads, source[deal]])
        apart = np.ones(len(source), bool)
        s, b = symbol[deal], block[deal]
        apart[ends + 1 :] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        common[apart & ~parted] = done
        if (apart == parted).all():
            break
        parted |= apart
    return source, common


def repeated(shards: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """For each shard's symbols, the places where ``depth`` symbols start that start elsewhere too."""
    built = [transform(s) for s in shards]
    source, common = merged(built, depth)
    again = common >= depth
    again[:-1] |= common[1:] >= depth
    return [np.sort(shard.starts[again[source == k]]) for k, shard in enumerate(built)]


def in_words(raw: np.ndarray, first: np.ndarray, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Texts as words of ``width`` bytes in each of their ``width`` phases, one text a phase.

    Returns the words' values with a closing -1 each, and the byte where each
    starts: ``depth * width`` bytes from any byte on are ``depth`` symbols.
    """
    n = len(raw)
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value[: n - j] |= raw[j:].astype(np.uint64) << np.uint64(8 * j)
    size = np.diff(first)
    phases = np.maximum(0, (size[:, None] - width - np.arange(width)[None]) // width + 1)
    base = np.cumsum(np.concatenate([[0], phases.ravel() + 1]))
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(n) - first[owner]
    whole = at + width <= size[owner]
    to = base[owner * width + at % width] + at // width
    values, byte = np.zeros(base[-1], np.uint64), np.full(base[-1], -1, np.int64)
    values[to[whole]] = value[whole]
    byte[to[whole]] = np.flatnonzero(whole)
    return values, byte
