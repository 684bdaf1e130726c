"""The training-data operators against brute force, with odd inputs."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from twins import connect, differences

from quillspar.llm import bwt, chat, components, decontam, elias_fano, jaccard, langid, ngram_trie, omh, packing, pii, queries, repeats, textops, toxicity


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


SCHEMA = "doc_id long, text string"
ODD = [None, "", " ", "x", "a b", "a b c", "a b c d", "é ü 日本 😀", "A\tB\nC", "w " * 5000, "same words here again", "same words here again", "́   x"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows and columns whose names operators use themselves."""
    rows = [(i, t, 0.5, "k", 3) for i, t in enumerate(ODD)] + [(12, ODD[12], 0.5, "k", 3), (12, "other text", 0.1, "j", 4), (None, "no id at all", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, key string, row int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, score double")


# ---- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \té1-😀\n", max_size=25), max_size=30))
def test_words(texts):
    raw, at = textops.utf8(pa.array(texts, pa.string()))
    raw = textops.lower(raw)
    words = textops.Words(raw, at, textops.SPACED)
    assert textops.texts(raw, words.start, words.end) == [w for t in texts for w in blank_words(t)]
    values, seen = words.values(), {}
    for w, v in zip([w for t in texts for w in blank_words(t)], values.tolist()):
        assert seen.setdefault(w, v) == v
    got, _ = textops.grams(values, words.first, 3)
    assert len(got) == sum(max(0, len(blank_words(t)) - 2) for t in texts)


# ---- 1 fingerprints


def test_fingerprints(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.append((doc, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = omh.edited_fingerprints(odd).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(repr, want))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert omh.edited_fingerprints(none).count() == 0


def test_fingerprints_follow_edit_distance():
    rng = random.Random(1)
    words = [rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(400)]
    near = [*words[:200], "new", *words[200:]]
    moved = [*words[200:], *words[:200]]
    shuffled = rng.sample(words, len(words))
    a, b, c, d, e = omh.signatures(*textops.utf8(pa.array([" ".join(x) for x in (words, near, moved, shuffled, words)])))
    assert (a == e).all()
    assert (a == b).mean() > 0.9 > (a == c).mean() > 0.3 > (a == d).mean()


# ---- 2 decontamination


def brute_contamination(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, found = set(), set()
    for item, t in items:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        k = min(13, len(x))
        windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_contamination(spark, odd, none, block):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)] + [(50, "Same WORDS here, again!"), (51, None), (52, "...")]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)] + [f"x {t} y {t}" for _, t in items[:6]]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], SCHEMA).unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.digest(decontam.contamination(docs, bench, block_bytes=block)).collect())))
    want = []
    for r in docs.collect():
        n, hit, found = brute_contamination(r.text, items)
        want.append((r.doc_id, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert got == sorted(map(repr, want))
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.digest(decontam.contamination(odd, bench.where("false"))).where("contaminated").count() == 0
    kept = decontam.decontaminated(odd.where("doc_id is not null"), bench, block_bytes=block)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()


# ---- 3 packing


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.word_tokenizer())
    rows = sorted(packing.power_of_two_pieces(odd, queries.word_tokenizer(), with_ids=True).collect(), key=lambda r: (repr(r.doc_id), r.sequence_id))
    pieces = defaultdict(list)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and len(r.ids) == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[repr(r.doc_id)].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    want = defaultdict(list)
    for r in odd.collect():
        want[repr(r.doc_id)].append(tool.encode(r.text or "", add_special_tokens=False).ids + [2])
    for key, texts in want.items():
        got, at = [], []
        for p in pieces[key]:
            if p.start == 0:
                got.append([])
            assert p.start == len(got[-1])
            got[-1].extend(p.ids)
            at.append(p.doc_tokens)
        assert sorted(got) == sorted(texts)
    assert packing.power_of_two_pieces(none, queries.word_tokenizer()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB'sd1 \t\né́ñΣς²<|>.-—×日\x1c\x85😀", max_size=30), max_size=20))
def test_chunks_tokenise_as_the_whole(texts):
    from tokenizers import Tokenizer

    texts = [*texts, "x<|endoftext|>Y's", "it's I'LL"]
    tool = Tokenizer.from_file(queries.word_tokenizer())
    ids, count = packing.encoder(queries.word_tokenizer()).encode(*textops.utf8(pa.array(texts)))
    want = [tool.encode(t, add_special_tokens=False).ids for t in texts]
    assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


# ---- 4 toxicity


def test_toxicity_learns(spark, sf, odd, none):
    found = queries.op4_kneser_ney_toxicity(spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id")
    held = found[found.held_out].join(labels, how="inner")
    ranks = held.score.rank()
    pos, neg = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (ranks[held.toxic == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) > 0.9
    assert (held.predicted[held.toxic == 1] == 1).mean() > 0.94 and (held.predicted[held.toxic == 0] == 0).mean() > 0.99
    model = toxicity.learn(odd.select("doc_id", "text"), odd.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("toxic")))
    got = toxicity.toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(none, model).count() == 0
    alone = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.without_toxic(odd, alone).count() == odd.count()


def kneser_ney(texts):
    """The models of both classes with dictionaries: p(class, word, word before), the vocabulary."""
    discount = lambda n, e, t, d: min(n, t + e**0.5 + d)
    tilt = lambda e, share: toxicity.TILT * e / (1 + (toxicity.TILT - 1) * share)
    grams = [{(g, h, w) for t in own for g, h, w in zip(["", "", *t], ["", *t], t, strict=False)} for own in texts]
    n = [Counter((h, w) for _, h, w in own) for own in grams]
    k = [Counter(w for _, w in own) for own in n]
    mass = [Counter() for _ in n]
    for c in (0, 1):
        for (h, _), m in n[c].items():
            mass[c][h] += m
    words, total = sorted({*k[0], *k[1]}), [sum(x.values()) for x in k]
    part = [t / sum(total) for t in total]
    taken = [{w: discount(k[c][w], part[c] * (k[0][w] + k[1][w]), tilt(part[c] * (k[0][w] + k[1][w]), part[c]), toxicity.WORD_DISCOUNT) for w in words} for c in (0, 1)]
    both = {w: taken[0][w] + taken[1][w] for w in words}
    kept = {w: max(both[w] - toxicity.WORD_DISCOUNT, 0) / sum(both.values()) for w in words}
    q = lambda w: kept.get(w, 0.0) + (1 - sum(kept.values())) / (len(words) + 1)
    one = lambda c, w: (k[c][w] - taken[c].get(w, 0)) / total[c] + sum(taken[c].values()) / total[c] * q(w)

    def pair(c, h, w):
        if not mass[c][h]:
            return one(c, w)
        share = mass[c][h] / (mass[0][h] + mass[1][h])

        def off(x):
            e, alone = share * (n[0][h, x] + n[1][h, x]), mass[c][h] * one(c, x)
            return discount(n[c][h, x], max(e, alone), max(tilt(e, share), toxicity.TILT * alone), toxicity.PAIR_DISCOUNT)

        spare = sum(off(x) for x in words if n[c][h, x]) / mass[c][h]
        return (n[c][h, w] - (off(w) if n[c][h, w] else 0)) / mass[c][h] + spare * one(c, w)

    return pair, words


def fitted(texts):
    values, before, _ = toxicity._tokens(pa.array([" ".join(t) for own in texts for t in own]))
    words = np.unique(values)
    toxic = np.repeat([False, True], [sum(map(len, own)) for own in texts])
    return toxicity.KneserNeyPair.fit(words, np.searchsorted(words, values).astype(np.int32), before == 0, toxic)


def test_kneser_ney_by_dictionaries():
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = [[[draw.choice(vocabulary[: 40 + 10 * c]) for _ in range(draw.randint(1, 9))] for _ in range(900 - 800 * c)] for c in (0, 1)]
    texts[1] += [[w, "w1", "w2", draw.choice(vocabulary)] for w in vocabulary[3:]]
    model, (want, words) = fitted(texts), kneser_ney(texts)
    assert len(model.pairs) > 0
    for c in (0, 1):
        for h in ["", "w1", "w3", "w45"]:
            assert abs(sum(want(c, h, w) for w in [*words, "unknown"]) - 1) < 1e-9
    asked = [["w1", "w2"], ["w3"], ["w11", "w0", "unknown", "w1"], ["unknown"], ["w2", "w1", "w2", "w49", "w8"]]
    got, count = model.log_likelihoods(pa.array([" ".join(t) for t in asked] + [None]))
    for i, t in enumerate(asked):
        for c in (0, 1):
            mean = sum(math.log(want(c, h, w)) for h, w in zip(["", *t], t, strict=False)) / len(t)
            assert abs(got[c][i] - mean) < 1e-9
    assert count.tolist() == [2, 1, 4, 1, 5, 0] and got[:, 5].tolist() == model.unseen.tolist()


def test_rare_and_joint_expressions_tell():
    """Many rare words of one class, and a phrase of words that both classes have, are told; copies teach nothing more."""
    draw = random.Random(3)
    neutral = [f"n{i}" for i in range(60)]
    plain = [[draw.choice(neutral) for _ in range(30)] for _ in range(800)]
    rare = [[draw.choice(neutral) for _ in range(25)] + [f"rare{draw.randrange(12)}" for _ in range(3)] for _ in range(40)]
    phrase = [[*[draw.choice(neutral) for _ in range(20)], "n1", "n2", "n3"] for _ in range(60)]
    model = fitted([plain, rare + phrase])
    ratio = model.log_ratios(pa.array(["n5 n9 n7 n30", "n5 rare3 rare7 n30", "n5 n1 n2 n30"]))
    assert ratio[1] > ratio[0] + 0.2 and ratio[2] > ratio[0] + 0.1
    again = fitted([plain, rare + [t for t in phrase for _ in range(5)]])
    assert np.allclose(again.log_ratios(pa.array(["n5 rare3 n1 n2"])), model.log_ratios(pa.array(["n5 rare3 n1 n2"])), atol=1e-6)


def test_toxicity_sample_is_bounded_in_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, 2, 5], pa.int64()), pa.array([1, 1, 1, 0], pa.int32()), pa.array(["c" * 40, "a" * 40, "b" * 40, "x" * 500])], names=["rank", "toxic", "text"])
    assert toxicity._sample([batch], 100) == [[b"x" * 500], [b"a" * 40, b"b" * 40]]


def test_toxicity_sample_is_not_cut():
    assert (toxicity.SAMPLE_ROWS, toxicity.FOLDS) == (6000, 4)


# ---- 5 language model


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=300), st.lists(st.integers(0, 2**62), max_size=20))
def test_elias_fano(values, asked):
    values = np.sort(np.array(values, np.uint64))
    e = elias_fano.EliasFano.encode(values)
    assert (e[np.arange(len(values))] == values).all()
    asked = np.array(asked, np.uint64)
    assert (e.successor(np.zeros(len(asked)), np.full(len(asked), len(values)), asked) == np.searchsorted(values, asked)).all()
    asked = np.concatenate([asked, values])
    there = np.isin(asked, values)
    assert (e.find(asked) == np.where(there, np.searchsorted(values, asked), -1)).all()


def test_language_model(spark, odd, none):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(1))}" for _ in range(4000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 4000, 40)]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], SCHEMA).unionByName(odd.select("doc_id", "text"))
    trie = ngram_trie.build(docs)
    counts = Counter(w for r in docs.collect() for w in [*blank_words(r.text), None])
    total, kinds = sum(counts.values()), len(counts)
    got = {}
    for r in ngram_trie.score(docs, trie).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (None, 12)]:
        tokens = [*blank_words(text), None]
        r = got[doc][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), len(tokens), total)
        assert abs(r.base_score - sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)) < 1e-6
        assert r.score <= 1e-9
    assert sum(r.score for x in got.values() for r in x) > sum(r.base_score for x in got.values() for r in x)
    empty = ngram_trie.build(none)
    assert all(r.n_known == 0 for r in ngram_trie.score(odd, empty).collect())
    assert ngram_trie.score(none, trie).count() == 0


def dictionary_model(texts):
    """log10 probability of a text under the model of three levels, with dictionaries and nothing quantised."""
    END = None
    tokens = [[*blank_words(t), END] for t in texts]
    one = Counter(w for t in tokens for w in t)
    two = Counter(p for t in tokens for p in zip([END, *t], t, strict=False))
    three = Counter(p for t in tokens for p in zip([END, *t], t, t[1:], strict=False))
    total, of = sum(one.values()), Counter(one.values())
    first = ngram_trie._discounts(*(of[k] for k in (1, 2, 3, 4)))
    off = lambda n, d: (0.0, *d)[min(n, 3)]
    spare = sum(off(n, first) for n in one.values()) / total
    sums, left, kids = (defaultdict(int) for _ in range(3))
    for table in (two, three):
        for key, n in table.items():
            sums[key[:-1]] += n
            kids[key[:-1]] += off(n, ngram_trie.JOINT_DISCOUNTS)
    left = {c: max(kids[c] / sums[c], 1e-6) for c in sums}

    def p(w, context):
        if not context:
            return (one[w] - off(one[w], first)) / total + spare / (len(one) + 1)
        below = p(w, context[1:])
        if context not in sums:
            return below
        n = (two if len(context) == 1 else three)[(*context, w)]
        return (n - off(n, ngram_trie.JOINT_DISCOUNTS)) / sums[context] + left[context] * below if n else left[context] * below

    def score(text):
        t = [*blank_words(text), END]
        return sum(math.log10(p(w, ((END,) if i == 0 else (t[i - 2] if i > 1 else END, t[i - 1])))) for i, w in enumerate(t))

    return score, p, list(one)


def test_counts_travel_with_their_words():
    most = (1 << ngram_trie.COUNT_BITS) - 1
    word, n = np.array([0, 7, 7, (1 << 39) - 1]), np.array([1, most, 2 * most + 5, most + 1])
    packed, row = ngram_trie._packed(word, n)
    assert row.tolist() == [0, 1, 2, 2, 2, 3, 3] and (packed >= 0).all()
    back, counts = ngram_trie._unpacked(packed)
    assert (back == word[row]).all() and np.bincount(row, counts).astype(np.int64).tolist() == n.tolist()
    packed = np.sort(packed)
    (words,), total = ngram_trie._summed((([w], c) for w, c in map(ngram_trie._unpacked, np.array_split(packed, 4))), 1)
    assert words.tolist() == [0, 7, (1 << 39) - 1] and total.tolist() == [1, 3 * most + 5, most + 1]


def test_trie_against_dictionaries(spark):
    """Each token's probability within a step of quantisation a level; probabilities sum to one."""
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["", "w1", "only once here", "only once here"]
    score, p, words = dictionary_model(texts)
    for context in [(), ("w1",), ("w1", "w2"), ("only", "once"), (None,), (None, "w1"), ("never",)]:
        mass = sum(p(w, context) for w in [*words, "unknown"])
        assert abs(mass - 1) < 1e-9 or context == ("w1", "never")
    trie = ngram_trie.build(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    asked = [*texts[:40], "unknown w1 w2 unknown", "only once here", "once only", "", "w3 never w3 w1"]
    got = {r.doc_id: r for r in ngram_trie.score(spark.createDataFrame(list(enumerate(asked)), SCHEMA), trie).collect()}
    for i, text in enumerate(asked):
        assert abs(got[i].score - score(text)) <= got[i].n_tokens * 3 * ngram_trie.STEP / 2 + 1e-6
    assert abs(sum(got[i].score - score(t) for i, t in enumerate(asked))) < 0.02 * sum(r.n_tokens for r in got.values())


def test_rare_pairs_are_nodes(spark):
    trie = ngram_trie.build(spark.createDataFrame([(i, "common words fill the rest") for i in range(20)] + [(20, "start rare1 rare2 stop"), (21, "start rare2 stop"), (22, "start rare1 stop")], SCHEMA))
    got = {r.doc_id: r.score for r in ngram_trie.score(spark.createDataFrame([(1, "fill rare1 rare2 fill"), (2, "fill rare2 rare1 fill")], SCHEMA), trie).collect()}
    assert got[1] > got[2] + 0.5


# ---- 6 chat


def test_perspectives(spark):
    rows = [(1, 0, "system", "be nice", "q"), (1, 1, "ann", "hi <|end|>", "q"), (1, 2, "bob", None, "q"), (1, 2, "bob", None, "q"), (1, 600, None, "late", "q"), (2, 0, "system", "alone", "q"), (None, None, "ann", "x", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size string")
    got = chat.perspectives(df, block_turns=2).collect()
    whole = defaultdict(dict)
    for r in got:
        whole[r.conv_id, r.perspective][r.seq] = r
    assert {k for k in whole} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    for (conv, who), parts in whole.items():
        text = "".join(parts[i].segment for i in sorted(parts))
        assert sorted(parts) == list(range(1, len(parts) + 1))
        for r in parts.values():
            assert text[r.char_start : r.char_end] == r.segment
            assert (r.chat_role == "assistant") == (r.speaker == who) == (r.mask_end > r.mask_start)
            if r.speaker == who:
                assert text[r.mask_start : r.mask_end].endswith("<|end|>")
    ann = "".join(whole[1, "ann"][i].segment for i in sorted(whole[1, "ann"]))
    assert ann.startswith("<|system|>\nbe nice<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n")
    assert chat.perspectives(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, name):
    d = "/root/testdata/sf0.001"
    assert differences(queries.queries()[name](spark, d), queries.oracle_sql()[name], connect(d)) == []


# ---- 7 repeated bytes


def brute_repeats(rows, length):
    counts = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for doc, b in rows:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append(repr((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("gram, group", [(12, 4096), (30, 3), (30, 4096)])
def test_repeats(spark, odd, none, gram, group):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(5, 120))) for _ in range(40)]
    rows = [(200 + i, "".join(rng.choice(base) for _ in range(rng.randint(0, 5)))) for i in range(60)] + [(200 + 60 + i, "".join(rng.choice("abcd") for _ in range(150))) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd.select("doc_id", "text"))
    want = brute_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], 40)
    got = repeats.without_repeats(docs, length=40, gram=gram, group_runs=group).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    only = spark.createDataFrame(rows, SCHEMA)
    want = brute_repeats([(d, t.encode()) for d, t in rows], 40)
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in repeats.without_repeats(only, length=40, gram=gram, group_runs=group).collect()) == want
    assert repeats.without_repeats(none).count() == 0


def test_merged_transforms():
    rng = random.Random(1)
    for _ in range(40):
        depth = rng.choice([1, 3, 8])
        base = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20))) for _ in range(5)]
        shards = [[b"".join(rng.choice(base) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 4))]
        counts = Counter(t[i : i + depth] for s in shards for t in s for i in range(len(t) - depth + 1))
        found = bwt.repeated([np.array([x for t in s for x in (*t, 0)]) for s in shards], depth)
        for shard, got in zip(shards, found):
            want, at = [], 0
            for t in shard:
                want += [at + i for i in range(len(t) - depth + 1) if counts[t[i : i + depth]] > 1]
                at += len(t) + 1
            assert got.tolist() == want


def test_a_long_text_in_parts(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("ab") for _ in range(700))
    monkeypatch.setattr(repeats, "PART_BYTES", 64)
    found = {(r["anchor"], r["string"]) for b in repeats._runs(40, 12)(iter([pa.RecordBatch.from_pydict({"row": [1], "text": [text]})])) for r in b.to_pylist()}
    spans = [(r["low"], r["high"]) for b in repeats._runs(40, 12)(iter([pa.RecordBatch.from_pydict({"row": [1], "text": [text]})])) for r in b.to_pylist()]
    assert found and sorted(i for a, b in spans for i in range(a, b + 1)) == list(range(len(text) - 39))


# ---- 8 language


def test_language(spark, odd, none):
    found = queries.op8_compression_langid(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id")
    held = found[found.held_out].join(docs[["lang"]])
    assert (held.lang_pred == held.lang).mean() > 0.95
    model = langid.learn(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("no label", None)] * 5)], "doc_id long, text string, lang string"))
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert all((r.best == "und") == (not any(map(str.isalpha, t or ""))) for r, t in zip(sorted(got, key=lambda r: repr(r.doc_id)), [x.text for x in sorted(odd.collect(), key=lambda r: repr(r.doc_id))]) if r.doc_id not in (None, 12))
    assert langid.identify(none, model).count() == 0
    assert {r.best for r in langid.identify(odd, langid.learn(none.withColumn("lang", F.lit("en")))).collect()} == {"und"}


def test_languages_behind_a_shared_header(spark):
    header = "permission is hereby granted free of charge to any person " * 20
    body = {"de": "der hund und die katze laufen durch den wald nach hause ", "en": "the dog and the cat are running through the woods to home "}
    model = langid.learn(spark.createDataFrame([(i, header + body[lang] * 60, lang) for i in range(40) for lang in body], "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([(i, text * 3) for i, text in enumerate(body.values())], SCHEMA), model)
    assert [r.best for r in got.orderBy("doc_id").collect()] == list(body)


# ---- 9 personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_personal_data(spark, odd, none):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a.@1 -+()9٣é😀5_x") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "call +1 (555) 555-1234 now", "192.168.1.256 1.2.3.4.5.6.7.8 0300.1.1.1", "4111 1111 1111 1111", 'token = "' + "0123456789abcdef" * 2 + '"', "😀 x@y.org"]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], SCHEMA).unionByName(odd.select("doc_id", "text"))
    got = pii.spans(docs).select("text", F.expr(pii.joined(True)).alias("base"), F.expr(pii.joined()).alias("every")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.base == base_spans(r.text)
        assert not r.base or set(r.base.split(",")) <= set(r.every.split(","))
    rows = pii.masked(pii.spans(odd.withColumn("text", F.concat(F.col("text"), F.lit(" x@y.org!")))))
    assert rows.columns == [*odd.columns, "spans"] and {r.text[-8:] for r in rows.collect() if r.text} == {"[EMAIL]!"}
    assert pii.spans(none).count() == 0


def test_personal_data_with_clashing_names(spark):
    names = ["_text", "_number", "_email", "_row", "_m", "proposed", "spans", "_base", "a.b"]
    df = spark.createDataFrame([(1, "mail x@y.org", *names)], ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    got = pii.masked(pii.spans(df)).collect()[0]
    assert got.text == "mail [EMAIL]" and got["_email"] == "_email" and got["a.b"] == "a.b" and len(got.spans) == 1


def test_tails_of_overlapping_spans_are_masked(spark):
    got = pii.masked(pii.spans(spark.createDataFrame([(1, "pay 4111 1111 1111 1111a@x.com now"), (2, "+1 415 555 0123.bob@x.com")], SCHEMA)))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "pay [CARD][EMAIL] now", 2: "[PHONE][EMAIL]"}


def test_reliabilities_span_by_span(spark):
    """Expectation maximisation over single spans, and the classifier's verdicts, in plain Python."""
    texts = [f"call +49 30 123456{i:02d} or mail a{i}@b{i}.com" for i in range(8)] + [f"account number 1234567890{i:03d} and x" for i in range(9)]
    texts += [f"token: '{'%032x' % (i * 7919 ** 9)}'" for i in range(6)] + [f"sum {'%040x' % (i * 104729 ** 9)}z {'%032x' % i ** 9}" for i in range(9)] + ["no numbers", None]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    proposed = pii.candidates(docs)
    model = pii.learn(proposed)
    each = [s for r in proposed.collect() for s in r.proposed]
    belief = [min(0.95, max(0.05, 0.5 + 0.2 * sum(s.votes))) for s in each]
    for _ in range(pii.EM_ROUNDS):
        prior = {k: (1 + sum(b for s, b in zip(each, belief, strict=True) if s.kind == k)) / (2 + sum(s.kind == k for s in each)) for k in pii.KINDS}
        rate = {}
        for j in range(len(pii.LABELERS)):
            for y in (0, 1):
                mass = {v: 1 + sum((b if y else 1 - b) for s, b in zip(each, belief, strict=True) if s.votes[j] == v) for v in (-1, 0, 1)}
                rate |= {(j, y, v): m / sum(mass.values()) for v, m in mass.items()}
        odds = [math.log(prior[s.kind] / (1 - prior[s.kind])) + sum(math.log(rate[j, 1, v] / rate[j, 0, v]) for j, v in enumerate(s.votes)) for s in each]
        belief = [1 / (1 + math.exp(-max(-30, min(30, o)))) for o in odds]
    for (j, y, v), r in rate.items():
        assert abs(model.reliability[pii.LABELERS[j], y, v] - r) < 1e-9
    assert all(abs(model.prior[k] - p) < 1e-9 for k, p in prior.items())

    def accepted(s):
        return sum(model.weights.get(k, 0.0) for k in ("bias", *(f"{f}={s[f]}" for f in pii.FEATURES))) >= 0

    want = set()
    for r in proposed.collect():
        base = [s for s in r.proposed if s.base]
        want |= {(r._row.doc_id, s.kind, s.start, s.end) for s in r.proposed if s.base or (accepted(s) and not any(b.start < s.end and s.start < b.end for b in base))}
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii.spans(docs, model).collect() for s in r.spans}
    assert got == want and any(k == "secret" for _, k, _, _ in got)


def test_learning_reads_each_pattern_once(spark):
    """No filter of all patterns is inferred from the explode."""
    proposed = pii.candidates(spark.createDataFrame([(1, "a@b.com")], SCHEMA))
    each = proposed.select(F.explode_outer("proposed").alias("s")).where("s is not null").groupBy("s.kind").count()
    assert each._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == len(pii.PATTERNS)


def test_secrets_are_added(spark):
    rows = [(i, f'words before token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and after') for i in range(50)]
    got = pii.spans(spark.createDataFrame(rows, SCHEMA)).select(F.expr(pii.joined()).alias("s")).collect()
    assert all(r.s.startswith("secret:") for r in got)


# ---- 10 Jaccard join


def shingle_set(text):
    w = blank_words(text)
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            at[g].append(d)
    for pair in {(a, b) for ds in at.values() for a in ds for b in ds if a < b}:
        a, b = (sets[x] for x in pair)
        if 100 * len(a & b) >= 85 * len(a | b):
            x, y = map(top, pair)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("links", [components.TASK_LINKS, 0])
def test_jaccard(spark, odd, none, links, monkeypatch):
    monkeypatch.setitem(components.components.__kwdefaults__, "task_links", links)
    if not links:
        monkeypatch.setattr(jaccard, "REGION_ROWS", 3)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 5, 8, 9, 12, 20, 40, 80]))] for _ in range(25)]
    rows = []
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            j = rng.randrange(len(w))
            w[j : j + 1] = rng.choice([[], [f"w{rng.randrange(60)}"]]) or ["z"]
        rows.append((100 + i, " ".join(w)))
    rows += [(i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == want
    kept = jaccard.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if d == c)


def test_jaccard_odd(spark, odd, none):
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == odd.count() and all(r.component_id is None for r in got if r.doc_id is None)
    kept = jaccard.one_of_each(odd).collect()
    assert Counter(t for r in kept if (t := " ".join(blank_words(r.text)))).most_common(1)[0][1] == 1
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_a_row_without_id_hides_no_links(spark):
    """The first of equal texts has no id: the others still enter the regions of their set."""
    words = [f"w{i}" for i in range(60)]
    near, far = " ".join([*words[:-1], "z"]), " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(None, " ".join(words)), (None, near), (3, " ".join(words)), (5, near), (7, far)], SCHEMA).coalesce(1)
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == {(None, None), (3, 3), (5, 3), (7, 7)}


def test_linked_sets_share_a_region():
    """Random pairs up to the threshold, small and large and around powers of two."""
    rng = np.random.default_rng(5)
    sets, linked = [], []
    for _ in range(1500):
        base = rng.integers(0, 1 << jaccard.BITS, max(6, int(rng.choice([rng.integers(6, 40), rng.integers(6, 400), (1 << rng.integers(3, 9)) + rng.integers(-2, 3)]))), dtype=np.uint64)
        most = jaccard.allowed(len(base))
        other = np.concatenate([rng.permutation(base)[rng.integers(0, most + 1) :], rng.integers(0, 1 << jaccard.BITS, rng.integers(0, most + 1), dtype=np.uint64)])
        if 0 < 100 * len(np.intersect1d(base, other)) >= 85 * len(np.union1d(base, other)) > 85 * len(np.intersect1d(base, other)):
            linked.append(len(sets))
            sets += [np.sort(base), np.sort(other)]
    text, region = jaccard.regions(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    own = defaultdict(set)
    for t, r in zip(text.tolist(), region.tolist(), strict=True):
        own[t].add(r)
    assert len(linked) > 500 and all(own[i] & own[i + 1] for i in linked)


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100), (7, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    for bound in (1000, 0):
        got = {r.key: r.component for r in components.components(df, task_links=bound).collect()}
        assert all(got[i] == 0 for i in range(61))


def test_find_asks_once_for_equal_values(monkeypatch):
    """Repeated, absent, first and last values, and one search of the unary part for both ends of a run."""
    rng, asked = np.random.default_rng(3), []
    select = elias_fano.EliasFano._place
    monkeypatch.setattr(elias_fano.EliasFano, "_place", lambda self, i, *rest: asked.append(len(i)) or select(self, i, *rest))
    for values in (np.unique(rng.integers(0, 1 << 40, 3000)), np.arange(700), np.array([0]), np.array([5, 1 << 50]), np.concatenate([np.arange(64), [1 << 30]]), np.zeros(0, np.int64)):
        known = elias_fano.EliasFano.encode(values.astype(np.uint64))
        x = np.concatenate([np.repeat(values, 3), values + 1, [0, 1, 1 << 55]])
        asked.clear()
        at = {v: i for i, v in enumerate(values.tolist())}
        assert known.find(x.astype(np.uint64)).tolist() == [at.get(v, -1) for v in x.tolist()]
        assert len(asked) == 1 and asked[0] <= len(np.unique(x))
